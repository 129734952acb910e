"""Conversation structure repair: the cheapest edits that make the turns of each conversation a well-formed dialogue.

A finite automaton accepts ``(s?(ua)+)?`` over the initials of roles. Turns are numbered without holding a conversation
in one task (sampled ranges of conversation and turn, one row of counts a range), cut into stretches of bounded length,
and dealt by hash into batches of bounded size. In each batch a recursive DuckDB query advances all conversations by one
turn at a time and keeps, for each state of the automaton in which a stretch can begin and each in which it can end, the
least cost and the ASCII-least audit. Stretches of long conversations are then put together by the same query, as many
levels as it takes. Two ways with one audit end in one text, so the audit alone tells the repaired turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import in_ranges, sums_before
from tidemark.llm.common import materialise, require

#: Turns of one stretch, and stretches that one level puts together; rows of one batch, on average.
STRETCH, BATCH_ROWS = 256, 20_000
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT = 1, 2, 3
SPACE = r"\x20\x09-\x0D"
#: State and next state by initial: 0 nothing yet, 1 after the system turn, 2 after the user's, 3 after the assistant's.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Cost and letters of the inserts that end a conversation from each state.
ENDINGS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
_DUCKDB: list = []

ADVANCE = """
WITH RECURSIVE lengths AS (SELECT key, part, max(i) + 1 AS n FROM steps GROUP BY ALL),
way(key, part, i, begun, state, best) AS (
  SELECT key, part, 0, b, b, {'cost': 0::BIGINT, 'audit': ''} FROM lengths, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE b = 0 OR part > 0
  UNION ALL
  SELECT w.key, w.part, w.i + 1, w.begun, s.state, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit})
  FROM way w JOIN steps s ON s.key = w.key AND s.part = w.part AND s.i = w.i AND s.begun = w.state GROUP BY ALL
)
SELECT key, part, begun::INTEGER AS begun, state::INTEGER AS state, best.cost AS cost, best.audit AS audit FROM way JOIN lengths USING (key, part) WHERE i = n
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32("conv_id:turn") mod 20: 0 drops a row, 1 empties its text, 2 takes out ``[.!?]``, 3 doubles it, 4 makes it the user's.

    A null is one space: in the hashed string, as a role and as a text. ``turn`` itself stays null.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("_kind")).where("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def key_of(conv_id: str) -> Column:
    """A conversation's key; that of a null conv_id is no string of another's."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(" "))


def numbered(rows: DataFrame) -> DataFrame:
    """A written table of key, turn, role, text, pos (from 0, by turn, nulls first; ties by role and text) and fault of every row.

    A row's first fault counts: BLANK has nothing but white space, DUPLICATE has the role and text of an earlier row, CUT's last
    other character isn't one of ``.!?``.
    """
    rows = rows.select(key_of("conv_id").alias("key"), "turn", "role", "text", F.monotonically_increasing_id().alias("_u"), F.lit(1).cast("long").alias("_one"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_u")]
    placed = sums_before(in_ranges(rows, "key", *order), ["key"], order, {"pos": "_one"}).drop("_range", "_u", "_one")
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    first = placed.where(~blank).groupBy("key", "role", F.sha2("text", 256)).agg(F.min("pos").alias("pos")).select(F.col("key").alias("f_key"), F.col("pos").alias("f_pos"))
    placed = placed.join(first, (F.col("key") == F.col("f_key")) & (F.col("pos") == F.col("f_pos")), "left")
    fault = F.when(blank, BLANK).when(F.col("f_pos").isNull(), DUPLICATE).when(cut, CUT).otherwise(0)
    return materialise(placed.select("key", "turn", "role", "text", "pos", fault.alias("fault")), "turns")


def moves() -> list[tuple[str, int, int, int, int, str]]:
    """initial, fault, state before, state after, cost, letters: every way over one row, with the inserts before it."""
    out = []
    inserts = [(s, s, 0, "") for s in range(4)]
    for s in range(4):
        one = GRAMMAR.get((s, "u"), GRAMMAR.get((s, "a")))
        inserts += [(s, one, INSERT, "I"), (s, GRAMMAR.get((one, "u"), GRAMMAR.get((one, "a"))), 2 * INSERT, "II")]
    for initial in ("s", "u", "a", ""):
        for fault in (0, BLANK, DUPLICATE, CUT):
            for s, at, cost, letters in inserts:
                out.append((initial, fault, s, at, cost + DELETE, letters + "D"))
                if fault in (BLANK, DUPLICATE):
                    continue
                more = TRUNCATED if fault == CUT else 0
                if (at, initial) in GRAMMAR:
                    out.append((initial, fault, s, GRAMMAR[at, initial], cost + more, letters + "K"))
                out += [(initial, fault, s, GRAMMAR[at, x], cost + more + REROLE, letters + "R") for x in ("u", "a") if (at, x) in GRAMMAR]
    return out


def connection():
    """The worker's DuckDB: one thread, nothing on disk, with the moves as a table."""
    import duckdb

    if not _DUCKDB:
        con = duckdb.connect(":memory:")
        con.execute("SET threads = 1; SET temp_directory = ''; SET preserve_insertion_order = false")
        con.execute("CREATE TABLE moves (initial VARCHAR, fault INTEGER, begun INTEGER, state INTEGER, cost BIGINT, audit VARCHAR)")
        con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
        _DUCKDB.append(con)
    return _DUCKDB[0]


def advanced(rows: DataFrame, steps: str, n: int) -> DataFrame:
    """key, part, begun, state, cost, audit of the best way over each part, in batches by hash of (key, part); ``steps`` makes steps of a batch's rows."""
    many = max(1, -(-n // BATCH_ROWS))

    def run(batch: pa.Table) -> pa.Table:
        con = connection()
        con.register("batch", batch)
        con.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {steps}")
        out = con.execute(ADVANCE).to_arrow_table()
        con.unregister("batch")
        return out.cast(pa.schema([("key", pa.string()), ("part", pa.int64()), ("begun", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    batched = rows.withColumn("batch", F.pmod(F.xxhash64("key", "part"), F.lit(many))).groupBy("batch")
    return batched.applyInArrow(run, "key string, part long, begun int, state int, cost long, audit string")


def audits(turns: DataFrame) -> DataFrame:
    """key, cost and audit of the cheapest edits of each conversation of ``numbered``."""
    rows = turns.select("key", (F.col("pos") / STRETCH).cast("long").alias("part"), (F.col("pos") % STRETCH).alias("i"), F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("").alias("initial"), "fault")
    size = turns.agg(F.count("*").alias("n"), F.max("pos").alias("last")).first()
    n, parts = size["n"], (size["last"] or 0) // STRETCH + 1
    ways = advanced(rows, "SELECT key, part, i, begun, state, cost, audit FROM batch JOIN moves USING (initial, fault)", n)
    while parts > 1:
        ways = materialise(ways, "ways")
        up = ways.select("key", (F.col("part") / STRETCH).cast("long").alias("part"), (F.col("part") % STRETCH).alias("i"), "begun", "state", "cost", "audit")
        ways = advanced(up, "SELECT key, part, i, begun, state, cost, audit FROM batch", 16 * (-(-n // STRETCH)))
        n, parts = -(-n // STRETCH), (parts - 1) // STRETCH + 1
    pick = lambda k: F.element_at(F.array(*(F.lit(ENDINGS[s][k]) for s in range(4))), F.col("state") + 1)
    ends = ways.select("key", F.struct((F.col("cost") + pick(0)).alias("cost"), F.concat("audit", pick(1)).alias("audit")).alias("best"))
    return materialise(ends.groupBy("key").agg(F.min("best").alias("best")).select("key", "best.*"), "audits")


def edits(found: DataFrame) -> DataFrame:
    """key, place (from 0), pos (of the row, null for an insert) and role (null where kept) of every turn that the audits leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, audit in zip(batch.column("key").to_pylist(), batch.column("audit").to_pylist(), strict=True):
                letter = np.frombuffer(audit.encode(), np.uint8)
                row = np.cumsum(letter != ord("I")) - 1
                stays = np.flatnonzero(letter != ord("D"))
                for lo in range(0, len(stays), 50_000):
                    own, place = stays[lo : lo + 50_000], np.arange(lo, min(lo + 50_000, len(stays)))
                    # an odd number of turns begins with the system's
                    role = np.where((place - len(stays) % 2) % 2 == 0, "user", "assistant")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(own)), pa.array(place), pa.array(row[own], mask=letter[own] == ord("I")), pa.array(role, pa.string(), mask=letter[own] == ord("K"))], ["key", "place", "pos", "role"]
                    )

    return found.select("key", "audit").mapInArrow(run, "key string, place long, pos long, role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation, with cost and audit of its repair; and the repaired turns.

    The first has key (see ``key_of``), gaps, blank, duplicate, truncated, illegal, cost and audit, the second key, place, role
    and text. Rows go by turn, nulls first, ties by role and text. Roles are told by their first letter; any but s, u and a
    can only be given another role or deleted. Null roles and texts count as one space. Rows of a null conv_id are one
    conversation. Repeated rows are duplicates. Columns but conv_id, turn, role and text are ignored, whatever their
    names. An empty table gives no rows. A conversation may be as long as the table: no task and no batch holds it.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = numbered(rows.select("conv_id", "turn", word("role"), word("text")))
    found = audits(turns)
    spans = turns.groupBy("key", "turn").agg(*(F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT, "truncated"))))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = spans.groupBy("key").agg(gaps.alias("gaps"), *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated")))
    initial = turns.select("key", "pos", F.substring("role", 1, 1).alias("x"))
    after = initial.select("key", (F.col("pos") - 1).alias("pos"), F.col("x").alias("y"))
    wrong = initial.join(after, ["key", "pos"]).where(~F.concat("x", "y").isin("su", "ua", "au")).groupBy("key").agg(F.count("*").alias("illegal"))
    report = counts.join(wrong, "key", "left").join(found, "key").withColumn("illegal", F.coalesce("illegal", F.lit(0)))
    left = edits(found)
    inserted = left.where("pos IS NULL").select("key", "place", "role", F.lit("").alias("text"))
    kept = left.where("pos IS NOT NULL").withColumnRenamed("role", "_role").join(turns, ["key", "pos"])
    return report, kept.select("key", "place", F.coalesce("_role", "role").alias("role"), "text").unionByName(inserted)


def digests(repaired: DataFrame) -> DataFrame:
    """key and repaired_sha256 of each conversation's ``role:text`` lines.

    The hash of a text is sequential by definition, so a conversation's lines pass in order through one task, as a stream
    that holds one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        names = ["key", "repaired_sha256"]
        for batch in batches:
            done = []
            for key, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], names)

    lines = repaired.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "place").select("key", "line").mapInArrow(run, "key string, repaired_sha256 string")


OP13_SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
crc AS (SELECT name, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))), 4294967295::BIGINT) % 20 AS kind FROM (SELECT DISTINCT name FROM raw)),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw JOIN crc USING (name), (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM rows_),
t AS (SELECT *, left(role, 1) AS x, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault, count(*) OVER (PARTITION BY conv_id) AS n FROM placed),
g(s, x, e) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
free(s, e, cost, letters) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'), (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
way(conv_id, pos, s, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': ''} FROM t
  UNION ALL
  SELECT w.conv_id, w.pos + 1, m.e, min({'cost': w.best.cost + f.cost + m.cost, 'audit': w.best.audit || f.letters || m.letter})
  FROM way w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos JOIN free f ON f.s = w.s
  JOIN (SELECT s, x, 'K' AS letter, 0 AS cost, e FROM g UNION ALL SELECT s, '*', 'R', 3, e FROM g WHERE x <> 's' UNION ALL SELECT s, '*', 'D', 4, s FROM (SELECT unnest([0, 1, 2, 3]) AS s)) q(s, x, letter, base, e) ON q.s = f.e AND q.x IN ('*', t.x)
  CROSS JOIN LATERAL (SELECT q.e AS e, q.letter AS letter, q.base + CASE WHEN q.letter <> 'D' AND t.fault = 3 THEN 3 ELSE 0 END AS cost) m
  WHERE q.letter = 'D' OR t.fault IN (0, 3) GROUP BY ALL),
best AS (SELECT w.conv_id, min({'cost': w.best.cost + f.cost, 'audit': w.best.audit || f.letters}) AS b FROM way w JOIN (SELECT conv_id, max(n) AS n FROM t GROUP BY conv_id) k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.n = w.pos
  JOIN free f ON f.s = w.s AND f.e IN (0, 3) GROUP BY w.conv_id),
letters AS (SELECT conv_id, unnest(string_split(b.audit, '')) AS letter, unnest(range(length(b.audit))) AS k FROM best WHERE b.audit <> ''),
counted AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) - 1 AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) - 1 AS place, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS many FROM letters),
sha AS (SELECT c.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN t.role ELSE CASE WHEN (place - many % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE t.text END, chr(10) ORDER BY place)) AS h
  FROM counted c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND t.pos = greatest(c.pos, 0) WHERE letter <> 'D' GROUP BY c.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM t GROUP BY conv_id),
pairs AS (SELECT conv_id, count(*) AS illegal FROM (SELECT conv_id, x, lead(x) OVER (PARTITION BY conv_id ORDER BY pos) AS y FROM t) WHERE y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au') GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sha s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13(spark, sf_dir: str) -> DataFrame:
    """The contract's row of every conversation of the table, damaged and repaired."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report, repaired = repair(damaged(conversations))
    rows = conversations.select("conv_id").distinct().withColumn("key", key_of("conv_id")).join(report, "key", "left").join(digests(repaired), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
