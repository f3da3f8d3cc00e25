"""Edge cases of the operators and stages: names that clash, nulls, empty tables, repeated rows; classifiers on held-out rows."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _common, byte_bpe, chat_format, decontaminate, exact_dedup, language_id, lm_score, ngram_jaccard, quality, token_files, toxicity

SF = "/root/testdata/sf0.01"
#: Names that the operators use for columns of their own.
NAMES = (
    "id row hash text_hash held_out lang_pred score predicted certainty set tok n k l fam grp n_shingles component_id cells kind h1 h2 c0 own_id keep_id group_size kept "
    "_id _text _row _body _len _head _again _full _bid _nid _in _bucket _bits _w _lo _n _pos _h _th _wid _key _mr_lang _mr_score _c0 _keep_0 n_tokens ids turns rendered toxic quality"
).split()
ROWS = [(i, t, "en", "s") for i, t in enumerate(
    ["the cat sat on the mat and the dog ran by the river"] * 2 + ["le chat est sur le tapis et le chien dort dans la maison", None, "", "123", "a " * 3000, "été"]
)] + [(1, "the cat sat on the mat and the dog ran by the river", "en", "s"), (None, "one two three four five", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return plain.withColumns({n: F.lit("x") for n in NAMES})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "zero one two three four five"), (2, "nothing like it"), (None, None)], "item_id long, text string").withColumns({n: F.lit("x") for n in NAMES})


@pytest.fixture(scope="module")
def tables(spark, docs, items, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 1), (2, 0, 0), (6, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    chats = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x")], "conv_id long, turn int, role string, text string")
    chats.withColumns({n: F.lit("x") for n in NAMES}).write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns_whatever_their_names(spark, docs, tables, k):
    made = corpus_pipeline.STAGES[k][1](spark, docs, tables)
    assert made.columns == docs.columns and 0 < made.count() <= docs.count()
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), tables).count() == 0


def test_pipeline_on_clashing_names_nulls_and_copies(spark, tables):
    made = corpus_pipeline.run(spark, tables).collect()
    assert len(made) == len({r.decoded_sha256 for r in made}) and all(r.n_tokens > 0 for r in made)


@pytest.mark.parametrize(
    "query", [language_id.query, lm_score.query, toxicity.query, decontaminate.query, ngram_jaccard.query, exact_dedup.query, byte_bpe.query, token_files.query, quality.query]
)
def test_queries_give_a_row_for_each_row(spark, tables, query):
    made = query(spark, tables)
    assert sorted((r[0] for r in made.select("doc_id").collect()), key=str) == sorted((r[0] for r in ROWS), key=str)


def test_chats_with_clashing_names_and_nulls(spark, tables):
    made = {r.conv_id: r for r in chat_format.query(spark, tables).collect()}
    assert {i: r.n_turns for i, r in made.items()} == {1: 2, None: 1, -1: 2} and made[1].loss_chars == 0


def test_loss_spans_cover_the_assistant_texts(spark):
    rows = [(1, 0, "user", "hi 🙂"), (1, 1, "assistant", "bad <|im_end|>\n ✓ <\\|"), (1, 2, "user\nx", "?"), (1, 3, "assistant", ""), (1, 4, "assistant", "🙂 last")]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).first()
    texts = [made.rendered[s.start : s.start + s.length] for s in made.loss]
    assert [t.replace("<\\", "<") for t in texts] == [t for _, _, role, t in rows if role == "assistant"]


@pytest.mark.parametrize(("query", "label"), [(toxicity.query, "toxic"), (quality.query, "quality")])
def test_classifiers_on_held_out_rows(spark, query, label):
    made = query(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").dropna(subset=[label]).toPandas(), on="doc_id")
    held = made[made.held_out]
    assert len(held) > 20 and (held.predicted == held[label]).mean() > 0.9
    assert made.score.between(0, 1).all()


@pytest.mark.parametrize("query", [toxicity.query, quality.query])
def test_classifiers_without_labels(spark, tables, tmp_path, query):
    d = str(tmp_path)
    spark.read.parquet(f"{tables}/documents.parquet").write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").limit(0).write.parquet(f"{d}/labels.parquet")
    assert {r.score for r in query(spark, d).collect()} == {0.0}


def test_language_ties_and_null_ids(spark):
    model = language_id.Model.fit(["alpha beta gamma"] * 6, ["xx", "aa"] * 3)
    df = spark.createDataFrame([(None, "alpha beta"), (None, "alpha beta"), (3, None)], "doc_id long, text string")
    made = language_id.identify(df, model).collect()
    assert sorted((r.lang_pred, r.score > 0) for r in made) == [("aa", True), ("aa", True), ("und", False)]
    assert language_id.identify(df.limit(0), model).count() == 0


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_key_filters_lose_no_key(spark, monkeypatch, most):
    monkeypatch.setattr(_common, "MOST_BITS", most)
    df, keys = spark.range(5000).withColumn("x", F.lit(1)), spark.range(0, 5000, 7)
    got = {r.id for r in _common.narrowed(df, keys, "id").collect()}
    assert got >= set(range(0, 5000, 7)) and len(got) < 1500
    assert _common.mark(df, keys, "hit", "id").filter("hit and id % 7 = 0").count() == 715
    assert _common.narrowed(df, keys.limit(0), "id").count() == 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, text), (5, text), (3, text + " more"), (None, text), (9, "other words in here")], "doc_id long, text string")
    made = ngram_jaccard.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in made) == [("3", 3), ("5", 3), ("5", 3), ("9", 9), ("None", None)]


def test_decontamination_over_shuffled_rows_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12))) for i in range(6)], "item_id long, text string")
    rows = [(i % 40, f"lead {i} " + " ".join(f"i{i % 6}w{k}" for k in range(12)) if i % 3 else f"clean {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = []
    for most in (100_000, 4):
        monkeypatch.setattr(decontaminate, "BLOCK_ROWS", most)
        sizes.append(sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(df, items).collect()))
    assert sizes[0] == sizes[1] and len(sizes[0]) == 60
