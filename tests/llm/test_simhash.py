import itertools
import random
import re

import numpy as np
import xxhash

from tillwatch.llm import simhash
from tillwatch.llm.components import components


def test_words_within_two_bits_share_a_key():
    table = simhash.error_table()
    one_of_each = np.array([min((e for e in row if e >= 0), key=lambda e: bin(e).count("1")) for row in table])
    own = simhash.golay_keys(one_of_each, table)
    assert set((own >= 0).sum(1)) == {1, 6}
    for weight in (1, 2):
        for bits in itertools.combinations(range(23), weight):
            other = simhash.golay_keys(one_of_each ^ sum(1 << b for b in bits), table)
            assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any((1, 2)).all()


def brute_components(prints, bits):
    prints = np.array(prints, np.uint64)
    label = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits
    while True:
        new = np.where(near, label, len(prints)).min(1)
        if (new == label).all():
            return label
        label = new


def planted():
    draw = random.Random(4)
    prints = [draw.getrandbits(64) for _ in range(150)] + [0, 1, 3, (1 << 64) - 1]
    for _ in range(250):
        p = draw.choice(prints)
        for b in draw.sample(range(64), draw.choice([1, 2, 2, 3])):
            p ^= 1 << b
        prints.append(p)
    return sorted(set(prints))


def test_links_reach_all_within_the_bits(spark):
    prints = planted()
    rows = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fingerprint long")
    for bits, bucket in ((2, 1024), (2, 2), (1, 2), (0, 1024)):
        links = simhash.links(rows, bits, bucket)
        roots = {r.node: r.root for r in components(links).collect()}
        mine = [roots.get(int(np.uint64(p).view(np.int64)), int(np.uint64(p).view(np.int64))) for p in prints]
        want = brute_components(prints, bits)
        assert len(set(zip(mine, want.tolist()))) == len(set(mine)) == len(set(want.tolist()))


def plain_print(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups(spark):
    long = " ".join(f"Word{i % 97}é" for i in range(5000))
    rows = [(9, "One two THREE"), (4, "one  two\nthree"), (5, "One two three É"), (7, None), (3, ""), (8, " \t"), (None, "one two three"), (11, long), (12, long.lower() + " end"), (4, "one  two\nthree")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, root int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = {i: plain_print(t, 3) for i, t in rows}
    for r in got:
        assert np.int64(r.fingerprint).view(np.uint64) == want[r.doc_id]
    component = {r.doc_id: r.component_id for r in got}
    assert component[9] == component[4] == component[None] == 4
    assert component[7] == component[3] == component[8] == 3
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or -1, r.root) for r in kept) == sorted((min((d for d in g if d is not None), default=-1) if None not in g else -1, 1) for g in groups(got))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component_id, set()).add(r.doc_id)
    return out.values()


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(1500, 1100), (1500, 1500)]
    draw = random.Random(0)
    names = {i: draw.getrandbits(62) for i in range(2000)}
    names[0], names[1000] = -5, 7
    links = [(names[a], names[b]) for a, b in path + star + path[:5]] + [(None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    one, two = {names[i] for i in range(61)}, {names[i] for i in [*range(1000, 1200), 1500]}
    assert got == {n: min(g) for g in (one, two) for n in g}
