"""Conversation repair, lexical ranking and benchmark windows against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import chat_repair, decontaminate, term_at_a_time
from ticketloom.llm.terms import words as words_of_bytes

FORM = re.compile(r"(s?(ua)+)?\Z")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [t.translate(LOWERED) for t in TERM.findall(text or "")]


def test_words_are_those_of_characters():
    for text in ["aB9-é_Z", "ß\x80x\x7fy", "İ ſ K", "", "  a　b", "x[y]^`{|}~@A"]:
        assert [w.decode() for w in words_of_bytes(text.encode())] == terms(text)


# Conversations


def faults(rows):
    """(role, text) in order to (role, text, fault)."""
    seen, found = set(), []
    for role, text in rows:
        held = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role, text, fault))
    return found


def applied(rows, audit):
    """Every outcome of edits with these initials: cost and turns."""
    at, done = 0, [(0, [])]
    for letter in audit:
        if letter == "I":
            done = [(c + 5, [*t, (r, "")]) for c, t in done for r in ("user", "assistant")]
            continue
        role, text, fault = rows[at]
        at += 1
        if letter == "D":
            done = [(c + 2, t) for c, t in done]
        elif fault in ("blank", "duplicate"):
            return []
        else:
            roles = [role] if letter == "K" else ["user", "assistant"]
            done = [(c + (letter == "R") + 5 * (fault == "truncated"), [*t, (r, text)]) for c, t in done for r in roles]
    return [(c, t) for c, t in done if FORM.match("".join(r[0] for r, _ in t))]


def every_audit(n):
    for letters in itertools.product("DKR", repeat=n):
        for gaps in itertools.product(("", "I", "II"), repeat=n + 1):
            yield "".join(g + x for g, x in zip(gaps, (*letters, "")))


def shortest(rows):
    """A table over turns with whole audits, for conversations too long to try everything."""
    steps = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", ())}

    def inserted(table):
        for _ in range(3):
            for state, (c, t, out) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in steps[state]:
                        new = (c + 5, t + "I", (*out, (role, "")))
                        key = steps[state][role[0]]
                        table[key] = min(table.get(key, new), new)
        return table

    best = inserted(best)
    for role, text, fault in rows:
        found = {}

        def offer(state, new):
            found[state] = min(found.get(state, new), new)

        for state, (c, t, out) in best.items():
            offer(state, (c + 2, t + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if role[0] in steps[state]:
                offer(steps[state][role[0]], (c + more, t + "K", (*out, (role, text))))
            for other in ("user", "assistant"):
                if other[0] in steps[state]:
                    offer(steps[state][other[0]], (c + 1 + more, t + "R", (*out, (other, text))))
        best = inserted(found)
    return min(best[s] for s in ("", "a") if s in best)


def searched(rows):
    done = []
    repair = chat_repair.Repair(lambda *edit: done.append(edit))
    for role, text, fault in rows:
        repair.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    cost = repair.end()
    return cost, "".join(e[0] for e in done), tuple((r, t) for _, r, t in done if r is not None)


def test_repair_tries_everything():
    random.seed(3)
    texts = ["a.", "b.", "", "cut", "c!"]
    for n in (0, 1, 2, 3):
        audits = list(every_audit(n))
        for _ in range(25):
            rows = faults([(random.choice(["system", "user", "assistant", "tool"]), random.choice(texts)) for _ in range(n)])
            outcomes = [(c, audit, tuple(t)) for audit in audits for c, t in applied(rows, audit)]
            assert searched(rows) == min(outcomes) == shortest(rows)


def test_repair_of_long_conversations():
    random.seed(4)
    for n, roles in ((40, "suat"), (300, "ua"), (200, "u"), (60, "t"), (120, "s"), (80, "a")):
        names = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
        for _ in range(6):
            rows = faults([(names[random.choice(roles)], random.choice(["", "x", "y.", f"{random.random()}."])) for _ in range(n)])
            assert searched(rows) == shortest(rows)


def test_repair_forgets_what_is_settled():
    done = []
    repair = chat_repair.Repair(lambda *edit: done.append(edit))
    for i in range(20_000):
        repair.turn("user" if i % 2 == 0 else "assistant", f"{i}.", False, False)
        assert i + 1 - len(done) < 8  # the unresolved part
    assert repair.end() == 0 and len(done) == 20_000


def spoilt(rows):
    """The damage, straight from its definition; (turn, role, text) of what is left, in order."""
    left = []
    for conv, turn, role, text in rows:
        role, text = role or " ", " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        move = zlib.crc32(key.encode()) % 20
        after = {1: "", 2: re.sub("[.!?]", "", text)}.get(move, text)
        place = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest())
        left += [(place, turn, "user" if move == 4 else role, after)] * {0: 0, 3: 2}.get(move, 1)
    return [r[1:] for r in sorted(left, key=lambda r: r[0])]


def audited(rows):
    left = spoilt(rows)
    turns = [t for t, _, _ in left if t is not None]
    marked = faults([(r, t) for _, r, t in left])
    cost, audit, out = shortest(marked) if left else (0, "", ())
    count = Counter(f for _, _, f in marked)
    illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    lines = "\n".join(f"{r}:{t}" for r, t in out)
    digest = hashlib.sha256(lines.encode()).hexdigest()
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_audits_of_the_tables(spark, folder):
    turns = spark.read.parquet(f"/root/testdata/{folder}/conversations.parquet")
    chats = defaultdict(list)
    for r in turns.collect():
        chats[r["conv_id"]].append((r["conv_id"], r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.audits(chat_repair.damaged(turns)).collect()}
    assert got == {conv: audited(rows) for conv, rows in chats.items()}


def test_audits_of_odd_turns(spark):
    rows = [(c, t, r, x, "k", 0) for c in (1, 2, None) for t in (None, 0, 1, 1, 2, 7) for r, x in (("user", "a."), (None, "b"), ("assistant", None))]
    rows += [
        (3, 1, "", "é.", None, None), (3, 2, "user", " \n", "k", 1), (3, 3, "userly", "x?", "k", 1), (3, 3, "userly", "x?", "k", 1),
        (3, 4, "assistant", "z" * 300_000 + ".", "k", 1),
    ]
    rows += [(4, i % 50, ("user", "assistant")[i % 2], f"{i % 90}.", "k", 0) for i in range(600)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, place int")
    chats = defaultdict(list)
    for r in rows:
        chats[r[0]].append(r[:4])
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.audits(chat_repair.damaged(table)).collect()}
    assert got == {conv: audited(own) for conv, own in chats.items()}
    edits = defaultdict(list)
    for r in chat_repair.repaired(chat_repair.damaged(table)).collect():
        edits[r["conv_id"]].append((r["place"], r["edit"], r["role"], r["text"]))
    for conv, own in edits.items():
        own.sort()
        assert "".join(e for _, e, _, _ in own) == got[conv][6]
        lines = "\n".join(f"{r}:{t}" for _, _, r, t in own if r is not None)
        assert hashlib.sha256(lines.encode()).hexdigest() == got[conv][7]
    kept = chat_repair.audits(chat_repair.undamaged(table)).collect()
    assert len(kept) == len(chats) and all(r["gaps"] >= 0 for r in kept)
    assert chat_repair.audits(chat_repair.damaged(table.limit(0))).count() == 0
    assert chat_repair.repaired(chat_repair.damaged(table.limit(0))).count() == 0


# Lexical ranking


def ranking(docs, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for t, c in df.items()}
    found = set()
    for item, own in asked.items():
        scores = []
        for place, (doc, counts) in enumerate(held):
            m = 10 + (90 * sum(counts.values()) * n) // total
            score = sum(weight[t] * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in own if t in counts)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0, place, doc))
        for rank, (score, _, _, _, doc) in enumerate(sorted(scores)[:k], 1):
            found.add((item, rank, doc, -score))
    return found


@pytest.mark.parametrize("block,pairs,seed", [(1 << 19, 500_000, 16), (64, 30, 2), (1, 500_000, 1)])
def test_ranking(spark, monkeypatch, odd, none, odd_rows, block, pairs, seed):
    monkeypatch.setattr(term_at_a_time, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(term_at_a_time, "PART_PAIRS", pairs)
    monkeypatch.setattr(term_at_a_time, "SEED_BLOCKS", seed)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = [(1000 + i, "the of and Zeta") for i in range(40)] + [(2000, "ZETA-é é"), (2001, None)]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    extra = [(900, "zeta é"), (900, "of"), (901, ""), (902, None), (None, "the the and"), (903, "nowhere4711")]
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    got = term_at_a_time.rank(docs, items).collect()
    want = ranking([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    asked = spark.createDataFrame([(1, "ten w1x1 alpha"), (2, "one two no id")], "item_id int, text string")
    got = term_at_a_time.rank(odd, asked, k=4).collect()
    assert {tuple(r) for r in got} == ranking([r[:2] for r in odd_rows], [(1, "ten w1x1 alpha"), (2, "one two no id")], 4)
    assert term_at_a_time.rank(none, asked).count() == 0 and term_at_a_time.rank(odd, asked.limit(0)).count() == 0


def test_accumulators_are_limited(monkeypatch):
    """With k good documents found by a rare term, a common one makes no further accumulators."""
    import numpy as np

    search = term_at_a_time.Search([[0, 1]], np.array([9000, 10]), 1000, 10_000, 3)
    row = {
        "lengths": np.full(1000, 10), "terms": np.array([0, 1]), "ends": np.array([5, 1005]),
        "places": np.concatenate((np.arange(5), np.arange(1000))), "times": np.ones(1005, int), "ids": list(range(1000)),
    }
    grown = []
    partition = np.partition
    monkeypatch.setattr(term_at_a_time.np, "partition", lambda a, k: grown.append((a > 0).sum()) or partition(a, k))
    best = [[]]
    search.block(row, best)
    assert [d for _, d in best[0]] == [0, 1, 2] and set(grown) == {5}


# Benchmark windows


def leaks(docs, items, size=10):
    grams = defaultdict(set)
    for item, text in items:
        own = terms(text)
        n = min(size, len(own))
        for i in range(len(own) - n + 1 if own else 0):
            grams[tuple(own[i : i + n])].add("" if item is None else str(item))
    lengths = {len(g) for g in grams}
    for doc, text in docs:
        own, hit, found = terms(text), set(), set()
        for n in lengths:
            for i in range(len(own) - n + 1):
                if (names := grams.get(tuple(own[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield doc, len(own), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("part", [100_000, 40])
def test_leaks(spark, monkeypatch, odd, none, odd_rows, part):
    monkeypatch.setattr(decontaminate, "PART_WINDOWS", part)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    extra = [(900, "of the"), (901, "The-OF"), (902, ""), (None, None), (None, "é"), (903, "one two three four five six seven eight nine ten eleven")]
    extra += [(904, "x x x x x x x x x x x x"), (905, "x x x x x x x x x x")]
    items = items.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    more = [(1000, "x " * 25), (1001, "é É"), (1002, "of"), (1002, "of, the of THE of"), (1003, None), (1002, "of, the of THE of")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    asked = [tuple(r) for r in items.collect()]
    got = Counter(tuple(r) for r in decontaminate.report(docs, items).collect())
    assert got == Counter(leaks([tuple(r) for r in docs.collect()], asked)) and sum(k[-1] for k in got) > 3
    got = Counter(tuple(r) for r in decontaminate.report(odd, items).collect())
    assert got == Counter(leaks([r[:2] for r in odd_rows], asked))
    assert decontaminate.report(none, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.report(odd, items.limit(0)).collect())


def test_removal(spark, odd, odd_rows):
    items = spark.createDataFrame([(1, "two three FOUR"), (2, "é Ünï")], "item_id long, text string")
    whole = decontaminate.decontaminated(odd, items)
    assert whole.columns == odd.columns and whole.count() == len(odd_rows) - 5
    cut = decontaminate.decontaminated(odd, items, spans_only=True)
    assert cut.columns == odd.columns
    got = Counter((r["doc_id"], r["text"]) for r in cut.collect())
    want = Counter()
    for doc_id, text, *_ in odd_rows:
        want[doc_id, text and re.sub(r"two\s+three\s+four|é Ünï", "", text)] += 1
    assert got == want


def test_colliding_windows(monkeypatch):
    """With every hash equal only the words tell windows apart."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(decontaminate, "rolled", lambda columns: np.zeros(columns.shape[1], np.uint64))
    held = decontaminate.WindowSet(pa.table({"item": ["1", "2", "2"], "window": [["a", "b"], ["b", "a"], ["a", "b"]]}))
    counts, spans, items = decontaminate._found([b"x a b a", b"b x a", None, b"b a"], held)
    assert counts == [4, 3, 0, 2] and items == {0: ["1", "2"], 3: ["2"]}
    assert spans == {0: [{"start": 1, "end": 4}], 3: [{"start": 0, "end": 2}]}
