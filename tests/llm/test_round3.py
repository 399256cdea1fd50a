"""Conversation repair, filter audit and context-tree weighting against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from lectern.llm import ctw, filters, turns

PATTERN_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_repair(rows):
    """(cost, audit, digest) by best-first search over all edits; rows: (role, text, fault)."""
    import heapq

    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        if (i, state) in done:
            continue
        done.add((i, state))
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        to = PATTERN_NEXT[state][role[0]]
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*out, f"{role}:")))
        if i < len(rows):
            had, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                fee = 3 * (fault == "truncated")
                heapq.heappush(heap, (cost + 3 + fee, audit + "R", i + 1, to, (*out, f"{role}:{text}")))
                if had[:1] in PATTERN_NEXT[state]:
                    heapq.heappush(heap, (cost + fee, audit + "K", i + 1, PATTERN_NEXT[state][had[:1]], (*out, f"{had}:{text}")))


def faulted(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else None if core[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


@pytest.mark.parametrize("parts", [1, 37])
def test_repairs(spark, parts):
    """Every conversation as by search, however many parts they span: parts of a few rows cut most of them."""
    r = random.Random(parts)
    texts = ["Yes.", "No!", "cut off", " \n", "What? ", "x.", "y.", "z."]
    conversations = {c: [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts) if r.random() < 0.6 else f"t{r.random()}.") for _ in range(r.choice([0, 1, 2, 5, 9, 60 if c < 4 else 3]))] for c in range(40)}
    rows = [(c, i, role, text, "k") for c, said in conversations.items() for i, (role, text) in enumerate(said)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(r.sample(rows, len(rows)), "conv_id long, turn long, role string, text string, conv string")
        ids = spark.createDataFrame([(c,) for c in conversations], "conv_id long")
        got = {x.conv_id: x for x in turns.repair(df, ids=ids).collect()}
        fixed = {}
        for x in turns.repair(df, turns=True).collect():
            fixed.setdefault(x.conv_id, []).append(x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 40
    for c, said in conversations.items():
        told = faulted(said)
        x = got[c]
        assert (x.cost, x.audit, x.repaired_sha256) == brute_repair(told), c
        assert (x.blank, x.duplicate, x.truncated, x.gaps) == (*(sum(f == k for *_, f in told) for k in ("blank", "duplicate", "truncated")), 0)
        assert x.illegal == sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(said))
        lines = [f"{t.role}:{t.text}" for t in sorted(fixed.get(c, []), key=lambda t: t.position)]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == x.repaired_sha256


def test_repairs_of_odd_rows(spark):
    """Null turns come first, null roles and texts are a space, a null id is a conversation, repeated rows are duplicates."""
    rows = [(1, 5, "assistant", "b."), (1, None, "user", "a."), (1, 5, "assistant", "b."), (1, 9, None, None), (None, 1, "user", "q?"), (2, None, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x for x in turns.repair(df).collect()}
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].blank, got[1].gaps, got[1].illegal) == ("KKDD", 8, 1, 1, 3, 2)
    assert (got[None].audit, got[None].cost) == ("KI", 3) and got[2].audit == "D" and got[2].gaps == 0
    assert turns.repair(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(10)]
    got = turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    kinds = {(c, t): zlib.crc32(f"{c}:{t}".encode()) % 20 for c, t, *_ in rows}
    want = [(c, t, "user" if k == 4 else "assistant", "" if k == 1 else "One Two" if k == 2 else "One. Two!") for (c, t), k in kinds.items() if k for _ in range(1 + (k == 3))]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_filter_audit(spark):
    """Each order applied one filter after the other, over rows with nulls, repeats and clashing names."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(70)]
    make = lambda: " ".join(r.choice(words[: r.choice([5, 70])]) for _ in range(r.choice([3, 60]))) + r.choice(["", " $", " ABCDEFGHIJKLMNOPQRST"])
    texts = [make() for _ in range(12)] + [None, ""]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice(["a", "b", None, ""]), "x") for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string")
    labels = spark.createDataFrame([(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(0, 60, 2), 4, 4, None]], "doc_id long, quality int, toxic int")
    marks = labels.collect()
    got = {(x.part, x.filter_order, x.step): x for x in filters.audit_filters(docs, labels).collect()}
    assert len(got) == 3 * 120 * 5 and filters.audit_filters(docs.limit(0), labels).count() == 0

    def fails(row):
        i, text, *_ = row
        text = text or ""
        w = text.split()
        first = min((k for k, t, *_ in rows if k is not None and (t or "") == text), default=None)
        return (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), i is not None and i > first)

    judged = [(row[2] or "", fails(row), any(m.doc_id == row[0] and m.quality == 1 for m in marks), any(m.doc_id == row[0] and m.toxic == 1 for m in marks)) for row in rows]
    taken = {}
    for part in ("a", "b", ""):
        for order in itertools.permutations(range(5)):
            left = [d for d in judged if d[0] == part]
            for step, i in enumerate(order, 1):
                gone = [d for d in left if d[1][i]]
                left = [d for d in left if not d[1][i]]
                all_failing = [d for d in judged if d[0] == part and d[1][i]]
                x = got[part, "".join("ABCDE"[k] for k in order), step]
                assert (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost) == (len(left), len(gone), len(all_failing) - len(gone), sum(sum(d[1]) == 1 for d in all_failing), sum(d[2] for d in gone), sum(d[3] for d in gone))
                taken[part, i] = taken.get((part, i), 0) + len(gone)
    assert all(x.shapley == taken[x.part, "ABCDE".index(x.filter_order[x.step - 1])] for x in got.values())


def plain_ctw(train, texts, depth=5):
    """Log10 probabilities by the definition, one node after the other, contexts as bytes."""
    counts = {}

    def nodes(raw, i):
        for k in range(8):
            yield 1 << k | raw[i] >> (8 - k), raw[i] >> (7 - k) & 1

    pad = lambda t: b"\xff" * depth + t.lower() + b"\xff"
    for t in map(pad, train):
        for i in range(depth, len(t)):
            for node, bit in nodes(t, i):
                for d in range(depth + 1):
                    counts.setdefault((t[i - d : i], node), [0, 0])[bit] += 1
    block = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(sum(n) + 1) - math.log(math.pi)
    kids, weight = {}, {}
    for d in range(depth, -1, -1):
        for (context, node), n in counts.items():
            if len(context) == d:
                own, rest = block(n), kids.get((context, node))
                whole = own if rest is None else np.logaddexp(own, rest) - math.log(2)
                weight[context, node] = 1.0 if rest is None else 1 / (1 + math.exp(min(700, rest - own)))
                if d:
                    kids[context[1:], node] = kids.get((context[1:], node), 0) + whole
    out = []
    for t in map(pad, texts):
        total = 0
        for i in range(depth, len(t)):
            for node, bit in nodes(t, i):
                p = 0.5
                for d in range(depth, -1, -1):
                    if n := counts.get((t[i - d : i], node)):
                        own, deeper = (n[0] + 0.5) / (sum(n) + 1), t[i - d - 1 : i] if d < depth else None
                        known = deeper is not None and (deeper, node) in counts
                        p = weight[t[i - d : i], node] * own + (1 - weight[t[i - d : i], node]) * p if known else own
                total += math.log10(1 - p if bit else p)
        out.append(total)
    return out


def test_context_tree_weighting(spark, monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice("abAé \n") for _ in range(r.choice([0, 1, 9, 300]))) for _ in range(60)] + [None, "zzz unseen", "日本"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "ab a"), (3, texts[3])]
    rows = [(*row[:2], "x", "y") for row in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, block string").repartition(3)
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    raw = [(t or "").encode() for _, t, *_ in rows]
    train = [t for t, row in zip(raw, rows) if not out(row[0])]
    want = {(row[0], t): s for row, t, s in zip(rows, raw, plain_ctw(train, raw))}
    counts, tokens = {}, 0
    for t in train:
        for w in [*t.lower().split(), None]:
            counts[w] = counts.get(w, 0) + 1
            tokens += 1
    whole = [np.concatenate(x) for x in zip(*ctw.Texts(raw).codes())]
    monkeypatch.setattr(ctw, "SLICE", 7)
    assert all((a == np.concatenate(b)).all() for a, b in zip(whole, zip(*ctw.Texts(raw).codes())))
    for block_bytes in (ctw.BLOCK_BYTES, 400):
        got = ctw.score_texts(docs, block_bytes=block_bytes).collect()
        assert len(got) == len(rows)
        for x in got:
            t = next(t for row, t in zip(rows, raw) if row[0] == x.doc_id)
            words = [*t.lower().split(), None]
            assert x.held_out == out(x.doc_id) and x.n_tokens == len(words) and x.n_known == sum(w in counts for w in words) and x.train_tokens == tokens
            assert math.isclose(x.base_score, sum(math.log10((counts.get(w, 0) + 1) / (tokens + len(counts) + 1)) for w in words), rel_tol=1e-9)
            assert math.isclose(x.score, want[x.doc_id, t], rel_tol=1e-9) and math.isclose(x.bits_per_byte, -x.score / math.log10(2) / (len(t) + 1))
    assert ctw.score_texts(docs.limit(0)).count() == 0
    unlearnt = ctw.score_texts(spark.createDataFrame([(i, "ab") for i in range(60) if out(i)], "doc_id long, text string")).collect()
    assert unlearnt and all(x.base_score == 0 and math.isclose(x.bits_per_byte, 8) for x in unlearnt)


def test_context_tree_is_a_distribution():
    """At every context, seen or not, the probabilities of all next bytes add up to 1."""
    r = np.random.default_rng(1)
    raw = ctw.Texts([bytes(r.integers(97, 100, 400, dtype=np.uint8))])
    codes = np.concatenate([c for _, c in raw.codes()])
    seen, n = np.unique(codes, return_counts=True)
    for context in (seen[5] >> np.uint64(8), np.uint64(0x6261FFFFFF), np.uint64(0x0102030405)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        both = np.unique(np.r_[seen, every])
        counts = np.zeros(len(both))
        counts[np.searchsorted(both, seen)] = n
        key, a, b, place, one = ctw.leaves(both, counts)
        root, *_, way = ctw.fold(key, a, b, ctw.block_probability(a, b), ctw.DEPTH)
        start = ctw.Carry(np.zeros(len(root)), np.ones(len(root)), np.full(len(root), 0.5))
        zero = start.down(way).past(a, b, 1.0).stop[place]
        p = np.where(one, 1 - zero, zero).reshape(8, -1).prod(0)
        assert math.isclose(p[np.searchsorted(both, every)].sum(), 1, rel_tol=1e-9)
