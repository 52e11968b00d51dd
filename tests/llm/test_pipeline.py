"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import corpus_pipeline as cp
from hushgrid.llm import packing, quality, simhash, toxicity as toxic
from hushgrid.plans.shared import stored, table

from ..conftest import SF
from .test_operators import check_pieces, slow_components, slow_fingerprint, slow_repeats


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    labels = table(spark, SF, "labels")
    scored = {r.doc_id: r.predicted for r in toxic.toxicity(docs, labels).collect()}
    one = stored(cp.drop_toxic(spark, docs, SF))
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {i for i, p in scored.items() if not p}
    two = stored(cp.drop_poor(spark, one, SF))
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {r.doc_id for r in quality.judge(one).where("kept").collect()}
    three = stored(cp.drop_near_copies(spark, two, SF))
    rows = [(r.doc_id, r.text) for r in two.collect()]
    group = slow_components([slow_fingerprint(t) for _, t in rows])
    want = {min(i for (i, _), g in zip(rows, group) if g == k) for k in set(group)}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == want
    four = stored(cp.cut_repeats(spark, three, SF))
    before = sorted((r.doc_id, r.text.encode().split()) for r in three.collect())
    gone = slow_repeats(before)
    left = {i: b" ".join(w for w, g in zip(words, gone[i]) if not g) for i, words in before}
    got = {r.doc_id: r for r in four.collect()}
    assert four.columns == columns and {i: b" ".join(r.text.encode().split()) for i, r in got.items()} == {i: t for i, t in left.items() if t}
    assert all(r.n_chars == len(r.text) for r in got.values())
    check_pieces(cp.pack_windows(spark, four, SF).collect(), {i: r.text for i, r in got.items()}, 1024)
    assert simhash.BITS == 3 and packing.FAN_IN == 64


def test_stages_on_awkward_rows(spark, docs, empty, tmp_path):
    """Nulls, empties, ties, repeated rows, a long text, columns of clashing names and empty tables, stage by stage."""
    from collections import Counter

    labels = spark.createDataFrame([(1, 0, 0), (7, None, 1), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    texts = lambda d: Counter((r.doc_id, r.text) for r in d.collect())
    whole = texts(docs)
    sound = {k: n for k, n in whole.items() if k[1] and len(k[1].split()) >= 50}
    for name, stage in cp.STAGES[:-1]:
        got, none = stored(stage(spark, docs, str(tmp_path))), stage(spark, empty, str(tmp_path))
        assert got.columns == none.columns == docs.columns and none.count() == 0, name
        rows = texts(got)
        if name == "toxicity":
            assert rows == whole
        elif name == "quality rules":
            assert all(sound.get(k) == n for k, n in rows.items())
        elif name == "near-duplicates":
            keyed = {}
            for (i, t), p in zip(whole, slow_components([slow_fingerprint(t) for _, t in whole])):
                keyed.setdefault(p, []).append((i is None, i or 0, t))
            assert {(r[0], r[1] or "") for r in rows} == {(None if n else i, t or "") for n, i, t in (min(v, key=lambda x: x[:2]) for v in keyed.values())} and set(rows.values()) == {1}
        else:
            assert all(t for _, t in rows) and sum(rows.values()) < sum(whole.values())
    pieces = cp.pack_windows(spark, docs, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) and sum(r.length for r in pieces) == sum(n * (len(packing.byte_bpe()(t)) + 1 if t else 1) for (_, t), n in whole.items())
    assert cp.pack_windows(spark, empty, str(tmp_path)).count() == 0
    for t, d in (("documents", empty), ("labels", labels.where("1 = 0"))):
        d.write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "near-duplicates", "substring dedup", "packing"]
