import corpus_pipeline as P

from .data import components, shingle_set
from .test_linededup import expected as deduplicated
from .test_wumanber import expected as contaminated



def test_stages(spark, sf):
    """Each stage against a brute-force version on what its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == columns
        rows = {r.doc_id: r for r in out.collect()}
        if k == 0:
            assert set(rows) < set(texts) and all(rows[d].text == texts[d] for d in rows)
        elif k == 1:
            want = {d: t for d, t, n, less in deduplicated(sorted(texts.items())) if not less or less < n}
            assert {d: r.text for d, r in rows.items()} == want
        elif k == 2:
            top = components({d: shingle_set(t) for d, t in texts.items()})
            assert set(rows) == {d for d in texts if top[d] == d}
        elif k == 3:
            assert set(rows) == {r[0] for r in contaminated(texts.items(), items) if not r[5]}
        else:
            assert set(rows) == set(texts) and all(r.exact for r in rows.values())
        if k < 4:
            docs = spark.createDataFrame(out.collect(), docs.schema)
            texts = {d: r.text for d, r in rows.items()}


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0
