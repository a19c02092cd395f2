"""Hard negatives, SimHash groups and conversation repair against direct computations, and their edge cases."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from condensa.llm import conversations, hard_negatives, queries, simhash
from condensa.llm.components import stars
from condensa.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_fingerprint(text):
    words = WORD.findall(lowered(text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """Index of the least member of each fingerprint's component."""
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


def test_op12_simhash(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    label = plain_groups(fps)
    got = {r.doc_id: r for r in queries.QUERIES["op12_simhash"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r, fp, at in zip(rows, fps, label):
        assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{fp:016x}", rows[at].doc_id)


def test_golay_keys_meet():
    rng = random.Random(1)
    pairs = []
    for _ in range(2000):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 2)):
            y ^= 1 << b
        pairs += [x, y]
    row, key = simhash.keys(np.array(pairs, np.uint64).view(np.int64))
    held = [set() for _ in pairs]
    for r, k in zip(row.tolist(), key.tolist()):
        held[r].add(k)
    assert all(held[i] & held[i + 1] for i in range(0, len(pairs), 2))


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_simhash_links(spark, monkeypatch, bucket):
    """Chains, hubs and strangers, with buckets small enough that neighbours decide."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket)
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:6]:
        for _ in range(12):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(stage(spark.createDataFrame([(x,) for x in signed], "fp bigint"), "t")).collect()
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)) for r in found)
    node, least = stars(np.array([r.a for r in found], np.int64), np.array([r.b for r in found], np.int64))
    label = dict(zip(node.tolist(), least.tolist()))
    groups = {}
    for x in signed:
        groups.setdefault(label.get(x, x), set()).add(x)
    want = {}
    for x, at in zip(signed, plain_groups(fps)):
        want.setdefault(at, set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_edges(spark):
    rows = [(None, "one two three four"), (5, "one  two\tTHREE four"), (5, "one two three four"), (7, None), (8, " \n"), (9, "x"), (10, "y " * 100_000), (11, "z" * 1_000_000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.link_groups(docs).collect()), key=str)
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [f for f in fps[3:5]] == [0, 0]
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, [5, 5, 5, 7, 7, 9, 10, 11])), key=str)
    assert got == want
    assert simhash.link_groups(docs.limit(0)).count() == 0


def plain_negatives(rows, positives=5, negatives=5):
    """rows: (id, label, vector of whole numbers); every tenth id is an anchor."""
    out = []
    for n, (i, label, v) in enumerate(rows):
        if i % 10:
            continue
        scores = sorted((-int(np.dot(v, w)), j, m, k) for m, (j, k, w) in enumerate(rows) if m != n)
        for s, j, m, _ in [x for x in scores if x[3] == label][:positives]:
            inside = [x for x in scores if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(inside)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "SHARD_ROWS", 50)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(0, 4)), np.floor(8 * (centres[rng.integers(0, 4)] + rng.normal(size=6) / 4)).tolist()) for i in range(240)]
    rows += [(240 + i, 1, rows[20][2]) for i in range(30)]  # ties
    table = spark.createDataFrame([(i, k, [x / 256 for x in v]) for i, k, v in rows], "vec_id bigint, label int, embedding array<double>")
    got = hard_negatives.mine(stage(hard_negatives.quantised(table), "t"), queries.F.col("id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)


def test_tree_spans():
    x = np.random.default_rng(0).normal(size=(50, 3))
    order, parent, distance = hard_negatives.spanning_tree(x)
    assert sorted(order.tolist()) == list(range(50)) and (parent == np.arange(50)).sum() == 1
    assert np.allclose(distance, np.sqrt(((x - x[parent]) ** 2).sum(1)))
    # least total length, by Kruskal
    pairs = sorted((float(np.linalg.norm(x[i] - x[j])), i, j) for i in range(50) for j in range(i))
    label, total = list(range(50)), 0.0
    for d, i, j in pairs:
        if label[i] != label[j]:
            total, old = total + d, label[i]
            label = [label[j] if k == old else k for k in label]
    assert abs(total - distance.sum()) < 1e-9


def test_hard_negatives_edges(spark):
    nan, schema = float("nan"), "vec_id bigint, label int, embedding array<double>, row string, grp string"
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.85, 0.0]), (3, 2, [nan, 0.0]), (4, None, [0.8, 0.0]), (None, 2, [0.9, 0.0]),
            (5, 2, None), (6, 2, [0.9, None]), (7, 2, [0.9]), (8, 2, []), (9, 2, [float("inf"), 0.0]), (100, 3, [1e-9, 0.0]), (200, 1, [-1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)

    def mine(t):
        return sorted(tuple(r) for r in hard_negatives.mine(stage(hard_negatives.quantised(t), "t"), queries.F.col("id") % 100 == 0).collect())
    a, p, n = 256 * 256, 256 * 230, 256 * 217  # floor(256 * 0.9), floor(256 * 0.85)
    both = [(0, 0, 1, 2, a, n), (0, 1, 1, 2, p, n)]
    assert mine(table) == sorted(both * 2)  # two anchors of id 0, each the other's positive
    assert mine(table.limit(0)) == []


def plain_repair(rows):
    """(role, text, fault) rows -> cost, audit, digest, by search over all edits."""
    @functools.cache
    def best(i, state):
        # states: 0 start, 1 after s, 2 after u, 3 after ua
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if i == len(rows):
            if state in (1, 2):
                c, a, t = best(i, to)
                options.append((c + 2, "I" + a, (("user:" if to == 2 else "assistant:"),) + t))
            return min(options)
        role, text, fault = rows[i]

        def edits(state):
            to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            c, a, t = best(i + 1, state)
            yield c + 3, "D" + a, t
            if fault < 2:
                c, a, t = best(i + 1, to)
                yield c + 2 + fault, "R" + a, (("user:" if to == 2 else "assistant:") + text,) + t
                for initial, end in {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]:
                    if role[:1] == initial:
                        c, a, t = best(i + 1, end)
                        yield c + fault, "K" + a, (f"{role}:{text}",) + t
        at, cost, letters, lines = state, 0, "", ()
        for _ in range(5):  # up to four inserts before the row
            options += [(cost + c, letters + a, lines + t) for c, a, t in edits(at)]
            at = {0: 2, 1: 2, 2: 3, 3: 2}[at]
            cost, letters, lines = cost + 2, letters + "I", lines + ("user:" if at == 2 else "assistant:",)
        return min(options)
    c, a, t = best(0, 0)
    return c, a, hashlib.sha256("\n".join(t).encode()).hexdigest()


def plain_conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, marked = set(), []
    for _, role, text in rows:
        tail = text.rstrip(" \t\n\v\f\r")
        fault = 2 if not tail else 3 if (role, text) in seen else 1 if tail[-1] not in ".!?" else 0
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    counts = [sum(m[2] == f for m in marked) for f in (2, 3, 1)]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, *plain_repair(tuple(marked)))


@pytest.mark.parametrize("piece", [3, 16])
def test_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    monkeypatch.setattr(conversations, "BRANCH", 2)
    rng = random.Random(piece)
    chats = {}
    for c in [None, *range(120)]:
        rows = [(rng.choice([None, *range(12)]) if rng.random() < .3 else t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "usher"]),
                 rng.choice(["Yes.", "No!", "Well", " ", "", "So?\n", "a. b", "é…", "text %d." % t])) for t in range(rng.choice([1, 2, 3, 5, 8, 14]))]
        chats[c] = rows
    table = spark.createDataFrame([(c, *r, "x") for c, rows in chats.items() for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string")
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(table).collect()}
    assert got == {c: plain_conversation(rows) for c, rows in chats.items()}


def test_repair_edges(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, at string"
    rows = [(1, 0, None, None), (2, None, "user", "Hi."), (2, None, "user", "Hi."), (3, 5, "user", "x" * 2_000_000 + "."), (3, 7, "assistant", " " * 1_000_000 + "Ok."), (4, 0, "assistant", "? " * 500_000)]
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair(table).collect()}
    want = {}
    for c, t, role, text, in rows:
        want.setdefault(c, []).append((t, role or " ", text or " "))
    assert got == {c: plain_conversation(r) for c, r in want.items()}
    assert conversations.repair(table.limit(0)).count() == 0
    assert conversations.damaged(table.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in range(40) for t in [None, *range(6)]] + [(None, 1, None, None)]
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
