import random
import re

import numpy as np
import pytest
import xxhash

from dossierflow.llm import simhash


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    label = list(range(len(prints)))
    for _ in prints:
        before = list(label)
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if before == label:
            return label
    return label


def close(rng, x, bits):
    return x ^ sum(1 << b for b in rng.sample(range(64), bits))


def test_fingerprints_and_components(spark, docs_of, awkward):
    rows = awkward + [(200 + i, " ".join(["Same Words here", "ÀB a b"] * 5)) for i in range(5)]
    rows += [(300, "one"), (301, "ONE two"), (302, "one  two\n"), (303, "x" * 200 + " y z")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = [plain_print(t) for _, t in rows]
    assert sorted((str(r.doc_id), r.fingerprint) for r in got) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(rows, prints))
    label = plain_components(prints)
    least = {}
    for (i, _), k in zip(rows, label):
        least[k] = min(i if i is not None else 1 << 60, least.get(k, 1 << 60))
    by_print = {f"{p:016x}": least[k] for p, k in zip(prints, label)}
    assert all(r.component_id == by_print[r.fingerprint] for r in got)


def test_every_pair_within_three_bits_has_a_chain():
    rng = random.Random(2)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = close(rng, x, rng.randint(0, 5))
        met = any(
            not (x ^ y) & simhash.EQUAL[k] and simhash.linked(np.array([x, y], np.uint64), k)[0, 1]
            for k in range(simhash.KINDS)
        )
        assert met == ((x ^ y).bit_count() <= 3)


@pytest.mark.parametrize("together", [4096, 4])
def test_links_in_small_and_split_buckets(spark, together):
    """Chains of near fingerprints, a dense ball and far ones; with a bound of 4 nearly all buckets are split."""
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(40)}
    x = rng.getrandbits(64)
    for _ in range(30):  # a chain of steps of three bits
        prints.add(x)
        x = close(rng, x, 3)
    prints |= {close(rng, x, rng.randint(0, 6)) for _ in range(60)}
    prints |= {0, 7, 1 << 63, (1 << 64) - 1}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, together).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in got)
    place = {p: i for i, p in enumerate(prints)}
    label = list(range(len(prints)))
    for _ in prints:
        for a, b in got:
            i, j = place[a], place[b]
            label[i] = label[j] = min(label[i], label[j])
    assert label == plain_components(prints)


def test_split_groups_are_bounded():
    for masks in simhash.FREE:
        assert masks and all(bin(m).count("1") == 12 for m in masks)


def test_text_ids_and_no_rows(spark):
    rows = [("b", "some words stand here"), ("a", "some words stand here"), ("c", None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {"a": "a", "b": "a", "c": "c"}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
