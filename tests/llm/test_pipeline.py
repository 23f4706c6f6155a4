import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = corpus_pipeline.settle(stage(spark, before, SF), name)
        assert kept.columns == columns and kept.dtypes == docs.dtypes, name
        assert 0 < kept.count() <= before.count()
        assert kept.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
    assert kept.where(F.char_length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_nulls_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(20).unionByName(spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6, "", "en", "s", 0)], docs.schema))
    for given in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            given = corpus_pipeline.settle(stage(spark, given, SF), "stage")
        assert given.columns[0] == "doc_id"


def test_columns_of_any_name_pass_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["row", "mark", "n_lines", "n_dropped", "score", "class_id", "__doc", "copies", "a.b", "bits", "d"]
    own = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own, plain = (corpus_pipeline.settle(stage(spark, x, SF), name) for x in (own, plain))
        assert own.columns == [*docs.columns, *names], name
        assert own.select(docs.columns).exceptAll(plain).count() == plain.exceptAll(own.select(docs.columns)).count() == 0
        for n in names:
            assert own.where(F.col(f"`{n}`") != F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string"))).count() == 0


def test_the_whole_pipeline_against_plain_python(spark, tmp_path):
    """All stages but the model's verdicts, by loops and all pairs."""
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    item = words("item", 20)
    texts = [words(1, 60), words(1, 59) + " other", words(2, 30) + "\na line that many documents share\n" + words(3, 9), "a line that many documents share\n" + words(4, 40), words(5, 20) + " " + item, words(6, 3000), "", None, "short"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"file://{folder}").collect()
    held, kept = set(), {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept[i] = "\n".join(x for x in lines if not (len(x.strip()) >= 10 and x.strip().lower() in held))
        held |= {x.strip().lower() for x in lines if len(x.strip()) >= 10}
    bags = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := t.split()) else set() for i, t in kept.items()}
    alike = lambda a, b: len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])
    stay = [i for i in kept if not any(alike(i, j) for j in kept if j < i) and item not in kept[i]]
    from tokenizers import Tokenizer

    from tablewright.llm import tokens

    library = Tokenizer.from_file(tokens.tokenizer_path())
    lengths = {i: len(library.encode(kept[i], add_special_tokens=False).ids) + 1 for i in stay}
    found = {}
    for r in rows:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
    assert found == lengths and set(texts.index(t) for t in texts) - set(stay) == {1, 4, 7}
