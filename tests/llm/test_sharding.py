import zlib

from dossierflow.llm import sharding


def test_laws(docs_of, awkward):
    rows = sharding.shard(docs_of(awkward), 5).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted(
        (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in awkward
    )
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_balance_and_order(docs_of):
    rows = sharding.shard(docs_of([(i, "ab" * (i % 50)) for i in range(2000)]), 24).collect()
    size = {s: sum(r.size for r in rows if r.shard == s) for s in range(24)}
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows)
    ordered = sorted(rows, key=lambda r: r.doc_id)
    assert [r.shard for r in ordered] == sorted(r.shard for r in rows)


def test_one_key_and_empty(docs_of):
    rows = sharding.shard(docs_of([(None, None)] * 300), 24).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    assert sharding.shard(docs_of([]).limit(0), 24).count() == 0


def test_plan_has_no_python(docs_of, awkward):
    plan = sharding.shard(docs_of(awkward), 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_against_brute_force(docs_of, awkward):
    """Rows laid end to end in the order of (doc_id, checksum); each is where its middle byte falls."""
    import zlib

    rows = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in awkward]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    total, before, slots, want = sum(r[1] for r in rows), 0, {}, []
    for i, size, crc in rows:
        shard = (2 * before + size) * 24 // (2 * total)
        want.append((i, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    got = sharding.shard(docs_of(awkward), 24).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
