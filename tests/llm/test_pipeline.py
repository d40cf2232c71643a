"""The pipeline against plain versions of its stages."""
import corpus_pipeline
from tapeloom.session import stage
from . import brute


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    columns = docs.columns
    outs = []
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = stage(step(spark, docs, brute.SF))
        if i < 4:
            assert docs.columns == columns
        outs.append({r["doc_id"]: r for r in docs.collect()})
    start = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()}
    known = {d: t for d, t in start.items() if t and any(c.isalpha() for c in t)}
    assert outs[0].keys() == known.keys()
    kept = {d: known[d] for d, _, c in brute.simhash_groups([*known.items()]) if d == c}
    assert {d: r["text"] for d, r in outs[1].items()} == kept
    gone = {}
    for cluster in brute.paragraph_clusters([*kept.items()]):
        for d, i in cluster:
            gone.setdefault(d, set()).add(i)
    lines = {d: r["text"] for d, r in outs[2].items()}
    assert lines.keys() == kept.keys()
    left = [w for t in lines.values() for line in t.split("\n") if len(w := brute.plain(line)) >= 20]
    assert brute.paragraph_clusters([(0, t) for t in lines.values()]) == [] and left
    for d, t in kept.items():
        if d not in gone:
            assert lines[d] == t
    items = [r["text"] for r in spark.read.parquet(f"{brute.SF}/benchmark.parquet").collect()]
    clean = {d: t for d, t in lines.items() if not any(brute.holds(t, i) for i in items)}
    assert {d: r["text"] for d, r in outs[3].items()} == clean
    made = brute.tokens([*clean.values()])
    assert {d: (r["ids"], r["text"]) for d, r in outs[4].items()} == dict(zip(clean, made))


def test_awkward_rows(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.read.parquet(f"{brute.SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for make in (brute.edge_docs, brute.no_docs):
        path = f"{folder}/{make.__name__}"
        make(spark).write.parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{brute.SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
        got = corpus_pipeline.run(spark, path).collect()
        ids = sorted((r["doc_id"] or 0) for r in got)
        assert ids == ([0, 4, 5, 7, 8, 9, 11, 12] if make is brute.edge_docs else [])
