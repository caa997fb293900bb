import random
import re

import numpy as np
import xxhash

from sedimark.llm import simhash as S
from sedimark.llm.components import components


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return [min((d for d, x in zip(ids, label, strict=True) if x == own and d is not None), default=None) for own in label]


def check(spark, rows):
    out = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, f string, fingerprint int")).collect()
    prints = [brute_print(t) for _, t, *_ in rows]
    wanted = zip((r[0] for r in rows), prints, brute_groups([r[0] for r in rows], prints), strict=True)
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out), key=repr) == sorted(wanted, key=repr)


def test_groups_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    long = [r.choice(vocabulary) for _ in range(400)]
    rows = [(None, "solo text of a nameless row"), (9, None), (10, ""), (11, " \t\n"), (12, "One"), (13, "one\x1cx two"), (14, " ".join(long) * 30), (15, "ÀÉ one two"), (15, "ÀÉ one two")]
    for i in range(40):
        near = list(long)
        for _ in range(r.randint(0, 3)):
            near[r.randrange(len(near))] = r.choice(vocabulary)
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, " ".join(r.choice(vocabulary) for _ in range(50))) for i in range(20)]
    check(spark, [(*row, "x", 1) for row in rows])


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_every_pair_within_the_radius_meets_at_every_level():
    r = random.Random(1)
    levels = S.levels()
    assert max(64 - m.bit_count() for covered in levels[2].values() for m in covered) <= 9
    for level in levels:
        for pinned in r.sample(sorted(level), min(8, len(level))):
            free = [b for b in range(64) if not pinned >> b & 1]
            for _ in range(300):
                apart = sum(1 << b for b in r.sample(free, 3))
                assert any(not m & apart for m in level[pinned])


def test_large_buckets_are_covered_again(spark, monkeypatch):
    """Fingerprints that share 40 bits, in buckets beyond the bound."""
    monkeypatch.setattr(S, "MAX_BUCKET", 16)
    r = random.Random(4)
    prints = sorted({r.getrandbits(24) for _ in range(300)} | {i for i in range(40)})
    rows = spark.createDataFrame([(p,) for p in prints], "f bigint")
    labels = {x.node: x.label for x in components(S.links(rows)).collect()}
    u = np.array(prints, np.uint64)
    group = list(range(len(u)))
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= 3).tolist():
            old, new = group[i], group[j]
            group = [new if g == old else g for g in group]
    least = {}
    for p, g in zip(prints, group, strict=True):
        least[g] = min(least.get(g, p), p)
    assert [labels.get(p, p) for p in prints] == [least[g] for g in group]


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (1, 0)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each(spark):
    rows = [(3, "a b c d e f", "x"), (2, "A b c d e f", "y"), (5, "quite another text here", "z"), (5, "quite another text here", "z"), (None, "a b c d e f", "n")]
    out = S.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string"))
    assert out.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id or 0, r.component_id) for r in out.collect()) == [(2, "y"), (5, "z")]
    only = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (4, None), (6, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in S.one_of_each(only).collect()) == [(0, "a b c"), (4, "")]
