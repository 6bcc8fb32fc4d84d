"""The pipeline on a planted corpus, stage by stage and as a whole."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, brute_line_dedup

import corpus_pipeline
from quillgraph.llm import jaccard_join, mixing, shared, toxicity


def words(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(10**5)}" for _ in range(n)]


def letters(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = [], []
    for i in range(300):
        w = letters(60, i)
        if i % 5 == 0:
            w.insert(20, "horrid")
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, i % 2, int(i % 5 == 0)))
    passage = " ".join(letters(60, 1001))
    rows[11] = (11, rows[11][1] + "\n" + passage, "en", "s3", 0)
    rows[12] = (12, rows[12][1] + "\n" + passage, "en", "s0", 0)
    rows[21] = (21, rows[16][1], "en", "s1", 0)  # an exact copy: loses all its lines
    near = rows[17][1].split()
    near[3] = "changed"
    rows[22] = (22, " ".join(near), "en", "s2", 0)  # a near copy
    item = " ".join(letters(40, 2001))
    rows[31] = (31, rows[31][1] + " " + item + " " + rows[31][1][::-1], "en", "s3", 0)
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontaminate", "mixing"]
    docs = first = shared.table(spark, sf, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.settle(stage(spark, docs, sf), "t")
        if name != "mixing":
            assert docs.columns == first.columns and docs.dtypes == first.dtypes
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i in range(300) if i % 5 == 0}
    assert not toxic & kept["toxicity"].keys()
    assert len(kept["toxicity"]) >= 300 - len(toxic)  # clean documents stay, and the two without text
    assert 21 not in kept["line_dedup"] and "\n" in kept["line_dedup"][11]["text"] and "\n" not in kept["line_dedup"][12]["text"]
    assert kept["line_dedup"][12]["n_chars"] == len(kept["line_dedup"][12]["text"])
    assert 22 in kept["line_dedup"] and 22 not in kept["jaccard_join"] and 17 in kept["jaccard_join"]
    assert kept["jaccard_join"].keys() - kept["decontaminate"].keys() == {31}
    assert kept["mixing"].keys() == kept["decontaminate"].keys() and {400, 401} <= kept["mixing"].keys()
    assert {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, sf).collect()} == {k: r["taken"] for k, r in kept["mixing"].items()}


def test_stages_by_brute_force(spark, sf):
    """Each stage on its own input: scores by the model alone, lines and components by comparing everything, the mix by its SQL."""
    folder = f"{sf}-brute"
    stages = dict(corpus_pipeline.STAGES)
    docs = shared.table(spark, sf, "documents")
    labels = shared.table(spark, sf, "labels")

    def step(name, docs):
        out = shared.settle(stages[name](spark, docs, sf), "brute")
        return out, sorted(((r["doc_id"], r["text"]) for r in out.collect()) if "text" in out.columns else [], key=repr)

    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = toxicity.fit(docs, labels)
    scores = toxicity.score_texts(model, pa.array([t for _, t in rows], pa.string()))
    docs, got = step("toxicity", docs)
    assert got == sorted([r for r, x in zip(rows, scores, strict=True) if x < 0.5], key=repr)
    left = brute_line_dedup([(*r, 0) for r in got])
    want = sorted([(got[i][0], t) for i, t in left.items() if t == got[i][1] or t.strip()], key=repr)
    docs, got = step("line_dedup", docs)
    assert got == want
    component = [c for _, _, c in brute_components(got, jaccard_join.CORPUS)]
    want = [r for r, c in zip(got, component, strict=True) if r[0] == c]
    docs, got = step("jaccard_join", docs)
    assert got == want
    item = "".join(c for c in shared.table(spark, sf, "benchmark").filter("item_id = 1").first()["text"] if c.isalnum())
    pieces = [item[k : k + 60] for k in range(len(item) - 59)]
    want = [r for r in got if not any(p in "".join(c for c in r[1] or "" if c.isalnum()) for p in pieces)]
    docs, got = step("decontaminate", docs)
    assert got == want
    docs.write.parquet(f"{folder}/documents")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents/*.parquet'")
    con.sql(f"create view labels as select * from '{sf}/labels.parquet/*.parquet'")
    mixed = sorted((r["doc_id"], r["size"], r["taken"]) for r in stages["mixing"](spark, docs, sf).collect())
    assert mixed == sorted(con.sql(f"select doc_id, size, taken from ({mixing.ORACLE})").fetchall())


def test_clashing_names(spark, sf):
    """Stages pass on columns whose names are those of columns that operators make."""
    names = ["id", "toxic", "doc", "gone", "every", "again", "did", "th", "root", "c", "a", "b", "text_key", "hash", "one"]
    docs = shared.table(spark, sf, "documents").select("*", *[F.lit("x").alias(n) for n in names])
    docs = docs.unionByName(docs.filter("doc_id = 41"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.settle(stage(spark, docs, sf), "clash")
        assert out.columns == docs.columns and 200 < out.count() <= docs.count(), name
        docs = out
    assert docs.filter("doc_id = 41").count() == 1


def test_empty_documents(spark, sf, tmp_path):
    shared.table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shared.table(spark, sf, t).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
