import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import conversations as C

SF = "/root/testdata/sf0.001"
GOOD = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, out = set(), []
    for _, _, role, text in rows:
        left = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        out.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, out


def all_ways(rows, bad):
    """Cost and audit of every way to edit, with up to three inserts at a place."""
    gaps = ["", "u", "a", "ua", "au", "uau", "aua"]
    best = None
    per_row = [["D"] if f in ("blank", "duplicate") else ["K", "u", "a", "D"] for f in bad]
    for ways in itertools.product(*per_row):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            made, cost, audit = holes[0], 3 * len(holes[0]), "I" * len(holes[0])
            for way, row, f, hole in zip(ways, rows, bad, holes[1:], strict=True):
                made += {"K": row[2][:1] or "?", "D": ""}.get(way, way) + hole
                cost += {"K": 0, "D": 4}.get(way, 3) + (3 if f == "truncated" and way != "D" else 0) + 3 * len(hole)
                audit += {"K": "K", "D": "D"}.get(way, "R") + "I" * len(hole)
            if (best is None or (cost, audit) < best) and GOOD.fullmatch(made):
                best = (cost, audit)
    return best


def cheapest(rows, bad):
    """The same for any length: ways in order of cost and audit from a heap; of one place and state the first is the best."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, s = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, audit
        if (i, s) in done:
            continue
        done.add((i, s))
        for x in "ua":
            if (s, x) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", i, step[s, x]))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s))
            more = 3 if bad[i] == "truncated" else 0
            if bad[i] not in ("blank", "duplicate"):
                if (s, rows[i][2][:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, step[s, rows[i][2][:1]]))
                for x in "ua":
                    if (s, x) in step:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, step[s, x]))
    raise AssertionError


def expected(rows):
    """The contract's row of one conversation's undamaged rows."""
    rows, bad = faults(damage(rows))
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    cost, audit = cheapest(rows, bad) if rows else (0, "")
    lines, own = [], iter(rows)
    for letter in audit:
        row = next(own) if letter != "I" else None
        if letter != "D":
            lines.append((row, letter))
    system = len(lines) % 2
    made = []
    for k, (row, letter) in enumerate(lines):
        role = row[2] if letter == "K" else ("user", "assistant")[(k - system) % 2]
        made.append(f"{role}:{row[3] if row else ''}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(bad.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made(rng, conv, n):
    texts = ["Yes.", "No!", "Why?", "And so", "", " \t\n", None, "Ok. \n", "été …", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "User"]
    turn, out = rng.randint(-2, 3), []
    for _ in range(n):
        out.append((conv, rng.choice([turn, turn, turn, turn, None]), rng.choice(roles[: rng.choice([3, 5, 10])]), rng.choice(texts[: rng.choice([4, 10])]) if rng.random() < 0.6 else f"Text {rng.randint(0, 99)}."))
        turn += rng.choice([0, 1, 1, 1, 2])
    return out


def answers(spark, rows, kind="long"):
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], f"conv_id {kind}, turn long, role string, text string, pos int, key string, place int").repartition(3)
    report, repaired = C.repair(C.damaged(df))
    sha = {r.key: r.repaired_sha256 for r in C.digests(repaired).collect()}
    return {r.key: (*(getattr(r, f) for f in FIELDS[:-1]), sha.get(r.key, hashlib.sha256().hexdigest())) for r in report.collect()}


def by_conversation(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_heap_equals_all_ways():
    rng = random.Random(6)
    for conv in range(250):
        rows, bad = faults(damage(made(rng, conv, rng.choice([0, 1, 2, 2]))))
        if len(rows) <= 2:
            assert cheapest(rows, bad) == all_ways(rows, bad), rows


@pytest.mark.parametrize("stretch, batch", [(256, 20_000), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, stretch, batch):
    """Whole conversations, with every text, role, turn and conv_id there is; the result doesn't depend on stretches and batches."""
    monkeypatch.setattr(C, "STRETCH", stretch)
    monkeypatch.setattr(C, "BATCH_ROWS", batch)
    rng = random.Random(9)
    rows = [r for conv in range(90) for r in made(rng, conv, rng.choice([1, 2, 3, 5, 8, 13]))]
    rows += made(rng, None, 6) + made(rng, 500, 40) + [(501, 3, "user", "Same.")] * 25 + [(502, None, "user", "Hm.")] * 2 + [(503, 1, "system", "Only.")]
    want = {" " if c is None else f"={c}": expected(own) for c, own in by_conversation(rows).items() if damage(own)}
    got = answers(spark, rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k


def test_edges(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = C.repair(C.damaged(empty))
    assert report.count() == 0 and C.digests(repaired).count() == 0
    long = "word " * 400_000 + "end."
    got = answers(spark, [("a b", 0, "user", long), ("a b", 1, "assistant", "Fine."), (" ", 1, "user", "Fine."), (None, 1, "user", "Fine."), (None, 2, "user", "Fine.")], "string")
    for conv, rows in {"=a b": [("a b", 0, "user", long), ("a b", 1, "assistant", "Fine.")], "= ": [(" ", 1, "user", "Fine.")], " ": [(None, 1, "user", "Fine."), (None, 2, "user", "Fine.")]}.items():
        assert conv not in got and not damage(rows) or got[conv] == expected(rows)


def test_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = {c: expected(rows) for c, rows in by_conversation([tuple(r) for r in table.collect()]).items()}
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in C.op13(spark, SF).collect()}
    assert got == want
