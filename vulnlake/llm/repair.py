"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows, in order, must give role initials ``(s?(ua)+)?``.  Rows
are kept, get another role, are deleted, or empty rows are inserted; the
cheapest edits are wanted, the ASCII-least of equal ones.

Four states say how far the initials have come: nothing yet (0), after ``s``
(1), after ``u`` (2), after ``a`` (3); 0 and 3 may end.  The cost still to come
from each state is a vector of four, and a row turns the vector behind it into
the one before it.  Conversations are cut into chunks of rows:

1. Every chunk runs backward from four speculative vectors, the extreme ones of
   those that can occur (``BOUND``): any real vector is a minimum of them plus
   constants.  Where the four results differ only by constants the chunk has
   converged: whatever follows, its vector is known up to a constant.
2. Fix-up passes go over the chunks that did not converge: each takes the
   vector of the chunk behind it, or, while that is not known either, joins
   its vectors with that chunk's and looks further on, so the number of passes
   is logarithmic in the number of chunks.
3. With the stitched vectors every chunk traces the least audit from each
   state; a chunk that ends in one state whatever its start has converged as
   well, and the same passes carry the start state from chunk to chunk.

Rows that must go (blank, duplicate) add the same cost in every state and are
deleted before anything is inserted, since ``D`` sorts before ``I``.

Order of rows: turn (null first), then role and the MD5 of the text.  Chunks
hold ``CHUNK`` rows, so a conversation may have any share of all rows.  Only
the last step reads a conversation as a whole, as its hash demands: it streams
over the sorted rows and keeps one byte of audit a row.  Null ids are one
conversation of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vulnlake.llm.common import ASCII_SPACES, in_batches, staged

CHUNK = 1024  # rows; a power of two
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 20  # more than any cost in a table
#: State after a row with initial s, u, a, or any other (-1: not allowed).
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1), "": (-1, -1, -1, -1)}
#: State after a row with the role that is due; the role itself is user but after a user row.
DUE = (2, 2, 3, 2)
ENDS = np.array([0, NEVER, NEVER, 0])
INITIALS = "sua"

# A row's code: role initial (index in INITIALS, 3: other) + 4 * fault
GOOD, BLANK, DUPLICATE, CUT = range(4)


def damage(rows: DataFrame) -> DataFrame:
    """The rows of conversations (conv_id, turn, role, text; nulls as one
    space in role and text) after the damage that their crc32 decides: 0 drops
    a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4
    makes it a user row."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    x = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"),
                    (F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return x.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _row_hash() -> Column:
    return F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))


def _fault() -> Column:
    last = F.substring(F.rtrim(F.col("text"), F.lit(" " + ASCII_SPACES)), -1, 1)
    return F.when(last == "", F.lit(BLANK)).when(~last.isin(".", "!", "?"), F.lit(CUT)).otherwise(F.lit(GOOD))


# ------------------------------ cost vectors -------------------------------

def _tables() -> tuple[np.ndarray, np.ndarray]:
    """step[code][s, t]: cost of a row from state s to t, insertions before it
    included; last[s]: cost to an end."""
    ins = np.full((STATES, STATES), NEVER)
    np.fill_diagonal(ins, 0)
    for s, t in enumerate(DUE):
        ins[s, t] = INSERT
    for _ in range(STATES):
        ins = np.minimum(ins, (ins[:, :, None] + ins[None, :, :]).min(1))
    step = np.full((16, STATES, STATES), NEVER)
    for fault in range(4):
        for i in range(4):
            m = step[i + 4 * fault]
            for s in range(STATES):
                m[s, s] = DELETE
                if fault in (BLANK, DUPLICATE):
                    continue
                extra = TRUNCATED if fault == CUT else 0
                kept = KEPT[INITIALS[i] if i < 3 else ""][s]
                if kept >= 0:
                    m[s, kept] = min(m[s, kept], KEEP + extra)
                m[s, DUE[s]] = min(m[s, DUE[s]], REROLE + extra)
            m[:] = np.minimum((ins[:, :, None] + m[None, :, :]).min(1), NEVER)
    return step, np.minimum((ins + ENDS[None, :]).min(1), NEVER)


STEP, LAST = _tables()


#: v[s] <= BOUND[s, t] + v[t] for the costs v still to come, whatever follows:
#: one state can do what another does, for the price of an insertion, or of the
#: deletion of an s row that is no longer due.
BOUND = np.array([[0, 0, 5, 0], [10, 0, 5, 10], [7, 5, 0, 5], [2, 0, 5, 0]])


def _padded(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks by falling size: their order, the codes as one matrix, and how
    many chunks each row is in."""
    size = np.array([len(c) for c in codes])
    order = np.argsort(-size, kind="stable")
    out = np.zeros((len(codes), size.max(initial=0)), np.int8)
    for i, c in enumerate(order):
        out[i, :size[c]] = np.frombuffer(codes[c], np.int8)
    return order, out, np.array([(size > i).sum() for i in range(out.shape[1])], int)


def speculate(codes: list[bytes]) -> np.ndarray:
    """[chunk, s, t]: costs before each chunk when those behind it are the
    speculative vector t."""
    order, matrix, live = _padded(codes)
    now = np.broadcast_to(BOUND, (len(codes), STATES, STATES)).copy()
    for i in range(matrix.shape[1] - 1, -1, -1):
        m = live[i]
        now[:m] = (STEP[matrix[:m, i]][:, :, :, None] + now[:m, None, :, :]).min(2)
    out = np.empty_like(now)
    out[order] = now
    return out


def converged(vectors: np.ndarray) -> np.ndarray:
    """Per chunk whether its four vectors differ only by constants."""
    level = vectors - vectors[:, :1, :]
    return (level == level[:, :, :1]).all((1, 2))


def trace(codes: list[bytes], behind: np.ndarray, is_last: np.ndarray) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Least audits of the chunks from each of the four states before them,
    their costs and the states behind them; ``behind``: [chunk, state]."""
    order, matrix, live = _padded(codes)
    n, rows = matrix.shape
    after = np.empty((rows, n, STATES), np.int32)  # costs behind each row
    now = behind[order].astype(np.int32)
    for i in range(rows - 1, -1, -1):
        m = live[i]
        after[i] = now
        v = (STEP[matrix[:m, i]] + now[:m, None, :]).min(2)
        now[:m] = v - v.min(1, keepdims=True)
    state = np.broadcast_to(np.arange(STATES), (n, STATES)).copy()
    cost = np.zeros((n, STATES), np.int64)
    kept = np.array([KEPT[c] for c in (*INITIALS, "")])
    due = np.array(DUE)
    letters: list[np.ndarray] = []  # each [chunk, start state], 0: none
    pick = np.arange(n)[:, None]
    for i in range(rows):
        m = live[i]
        code, at, p = matrix[:m, i], state[:m], pick[:m]
        fault, initial = code // 4, (code % 4)[:, None]
        stays = ((fault == GOOD) | (fault == CUT))[:, None]
        extra = np.where(fault == CUT, TRUNCATED, 0)[:, None]
        ahead = after[i, :m]
        before = (STEP[code] + ahead[:, None, :]).min(2)
        pending = np.ones((m, STATES), bool)
        while pending.any():  # the letters in their order, as long as they are on a cheapest way
            want = before[p, at]
            delete = pending & (DELETE + ahead[p, at] == want)
            insert = pending & ~delete & (INSERT + before[p, due[at]] == want)
            k = kept[initial, at]
            keep = pending & ~delete & ~insert & stays & (k >= 0) & (KEEP + extra + ahead[p, np.maximum(k, 0)] == want)
            rerole = pending & ~delete & ~insert & ~keep
            letters.append(np.zeros((n, STATES), np.uint8))
            letters[-1][:m] = np.select([delete, insert, keep, rerole], [ord("D"), ord("I"), ord("K"), ord("R")], 0)
            cost[:m] += np.select([delete, insert, keep, rerole], [DELETE, INSERT, KEEP + extra, REROLE + extra], 0)
            at = np.select([insert | rerole, keep], [due[at], k], at)
            pending = insert
        state[:m] = at
    for _ in range(2):  # insertions behind the last row of a conversation
        insert = is_last[order][:, None] & (ENDS[state] > 0)
        letters.append(np.where(insert, ord("I"), 0).astype(np.uint8))
        cost += np.where(insert, INSERT, 0)
        state = np.where(insert, due[state], state)
    whole, back = np.stack(letters, -1), np.empty(n, int)
    back[order] = np.arange(n)
    return [[row[row > 0].tobytes() for row in whole[b]] for b in back], cost[back], state[back]


# --------------------------------- passes ----------------------------------

KEY = ["_null", "_conv"]


def _with_key(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType
    return rows.withColumns({"_null": F.col("conv_id").isNull(), "_conv": F.coalesce(F.col("conv_id"), F.lit("0").cast(kind))})


def _key_schema(frame: DataFrame) -> str:
    return f"_null boolean, _conv {frame.schema['_conv'].dataType.simpleString()}"


def ordered_codes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(key, place, turn, code) of damaged rows; ``place`` grows along the
    order of the rows.  Range partitioned, so a large conversation is dealt
    over tasks; equal rows change nothing in whatever order."""
    order = [*KEY, F.col("turn").asc_nulls_first(), "role", "_h", "_salt"]
    keyed = _with_key(rows).select(*KEY, "turn", "role", _row_hash().alias("_h"), _fault().alias("_f"), F.monotonically_increasing_id().alias("_salt"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(spark, keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        *KEY, "turn", "_h", "_f", F.substring("role", 1, 1).alias("_i"), F.monotonically_increasing_id().alias("place")), "repair-rows")
    # a row is no duplicate if it is the first of its text; groups shrink before the shuffle
    firsts = placed.where(F.col("_f") != BLANK).groupBy(*KEY, "_h").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("_first"))
    initial = F.when(F.col("_i") == "s", 0).when(F.col("_i") == "u", 1).when(F.col("_i") == "a", 2).otherwise(3)
    fault = F.when((F.col("_f") != BLANK) & F.col("_first").isNull(), F.lit(DUPLICATE)).otherwise(F.col("_f"))
    return placed.join(firsts, "place", "left").select(*KEY, "place", "turn", "_i", fault.alias("fault"), (initial + 4 * fault).cast("tinyint").alias("code"))


def chunks(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """One row per chunk: its codes in order, its number in the conversation
    and whether it is the last one.  Numbers come from counts per partition."""
    size = CHUNK.bit_length() - 1
    cell = [*KEY, F.shiftright("place", 33).alias("_part"), F.shiftright("place", size).alias("_chunk")]
    packed = F.sort_array(F.collect_list(F.struct("place", "code", "_i")))
    cut = coded.groupBy(*cell).agg(packed.alias("rows"))
    cut = staged(spark, cut.select(*KEY, "_part", "_chunk", F.col("rows.code").alias("codes"), F.col("rows._i").alias("initials")), "repair-cut")
    heads = cut.groupBy(*KEY, "_part").agg(F.min("_chunk").alias("_least"), F.count(F.lit(1)).alias("_n"))
    # as many rows a conversation as it has partitions
    w = Window.partitionBy(*KEY).orderBy("_part")
    heads = heads.select(*KEY, "_part", "_least", (F.sum("_n").over(w) - F.col("_n")).alias("_base"),
                         F.sum("_n").over(Window.partitionBy(*KEY)).alias("_all"))
    number = F.col("_base") + F.col("_chunk") - F.col("_least")
    return cut.join(heads, [*KEY, "_part"]).select(*KEY, number.alias("nr"), (number + 1 == F.col("_all")).alias("is_last"), "codes", "initials")


def _as_bytes(codes: pd.Series) -> list[bytes]:
    return [np.asarray(c, np.int8).tobytes() for c in codes]


def _speculated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        v = speculate(_as_bytes(b["codes"]))
        last = b["is_last"].to_numpy()
        v[last] = (v[last] + LAST[None, None, :]).min(2)[:, :, None]  # nothing follows: the costs are known
        v -= v.min((1, 2), keepdims=True)
        yield pd.DataFrame({"_null": b["_null"], "_conv": b["_conv"], "nr": b["nr"], "v": list(v.reshape(len(v), -1)), "known": converged(v)})


def _joined(first: Column, second: Column) -> Column:
    """Vectors of a chunk and of the one behind it (16 costs each) → those of both, less the least."""
    both = F.array(*[F.array_min(F.array(*[F.get(first, F.lit(4 * s + m)) + F.get(second, F.lit(4 * m + t)) for m in range(STATES)]))
                     for s in range(STATES) for t in range(STATES)])
    return F.transform(F.array(both), lambda x: F.transform(x, lambda c: c - F.array_min(x)))[0]


def _constant(v: Column) -> Column:
    """Whether four vectors (16 costs) differ only by constants."""
    levels = F.array(*[F.array(*[F.get(v, F.lit(4 * s + t)) - F.get(v, F.lit(t)) for s in range(STATES)]) for t in range(STATES)])
    return F.size(F.array_distinct(levels)) == 1


def stitch(spark: SparkSession, table: DataFrame, step: int, combine, is_known, name: str) -> DataFrame:
    """Fix-up passes.  ``table``: (key, nr, v, known) for every chunk; an
    unknown one takes in the chunk ``step`` further on, and with it that
    chunk's own reach, until what it holds is known.  Each pass doubles the
    reach, and only the unknown chunks are written again."""
    table = staged(spark, table.select(*KEY, "nr", "v", "known", (F.col("nr") + step).alias("_next")), name)
    known, todo = table.where("known"), table.where("not known")
    while todo.limit(1).count():
        seen = known.unionAll(todo).select(*[F.col(c).alias(f"_o{c}") for c in (*KEY, "nr", "v", "known", "_next")])
        same = (F.col("_null") == F.col("_o_null")) & (F.col("_conv") == F.col("_o_conv")) & (F.col("_next") == F.col("_onr"))
        fixed = todo.join(seen, same).select(*KEY, "nr", combine(F.col("v"), F.col("_ov")).alias("v"), "_oknown", F.col("_o_next").alias("_next"))
        fixed = staged(spark, fixed.select(*KEY, "nr", "v", (F.col("_oknown") | is_known(F.col("v"))).alias("known"), "_next"), name)
        known, todo = known.unionAll(fixed.where("known")), fixed.where("not known")
    return known.select(*KEY, "nr", "v")


def _traced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        behind = np.stack([np.asarray(x, np.int64) for x in b["behind"]])
        audits, costs, ends = trace(_as_bytes(b["codes"]), behind, b["is_last"].to_numpy())
        first = (b["nr"] == 0).to_numpy()
        ends = np.where(first[:, None], ends[:, :1], ends)  # a conversation starts in state 0
        yield pd.DataFrame({"_null": b["_null"], "_conv": b["_conv"], "nr": b["nr"], "audits": [[a.decode() for a in x] for x in audits],
                            "costs": list(costs), "v": list(ends), "known": (ends == ends[:, :1]).all(1)})


def least_audits(spark: SparkSession, cut: DataFrame) -> DataFrame:
    """Chunks → (key, nr, audit, cost): the edits of their rows, insertions included."""
    in_batches(spark)
    key = f"{_key_schema(cut)}, nr long"
    spec = cut.select(*KEY, "nr", "is_last", "codes").mapInPandas(_speculated, f"{key}, v array<int>, known boolean")
    vectors = stitch(spark, spec, 1, _joined, _constant, "repair-vectors")
    ahead = vectors.select(*KEY, (F.col("nr") - 1).alias("nr"), F.array(*[F.get("v", F.lit(4 * s)) for s in range(STATES)]).alias("behind"))
    held = cut.select(*KEY, "nr", "is_last", "codes").join(ahead, [*KEY, "nr"], "left")
    held = held.withColumn("behind", F.coalesce("behind", F.array(*[F.lit(int(x)) for x in LAST])))
    traced = staged(spark, held.mapInPandas(_traced, f"{key}, audits array<string>, costs array<int>, v array<int>, known boolean"), "repair-traced")
    ends = stitch(spark, traced, -1, lambda v, before: F.transform(before, lambda s: F.get(v, s)),
                  lambda v: F.size(F.array_distinct(v)) == 1, "repair-states")
    starts = ends.select(*KEY, (F.col("nr") + 1).alias("nr"), F.get("v", F.lit(0)).alias("_start"))
    start = F.coalesce("_start", F.lit(0))
    return traced.join(starts, [*KEY, "nr"], "left").select(*KEY, "nr", F.get("audits", start).alias("audit"), F.get("costs", start).alias("cost"))


# --------------------------------- results ---------------------------------

#: The role that is due in each state.
ROLES = ("user", "user", "assistant", "user")


def _edited(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows sorted by conversation, audits before texts → (key, role, text) of
    each repaired row and (key, None, audit) behind each conversation.  Texts
    are read as they come; only the audit of a conversation is held."""
    current, audit, at, state = None, "", 0, 0

    def inserted(letter: str) -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == letter:
            yield current, ROLES[state], ""
            at, state = at + 1, DUE[state]

    for b in batches:
        for null, conv, kind, role, text in zip(b["_null"], b["_conv"], b["_kind"], b["role"], b["text"]):
            if (null, conv) != current:
                if current is not None:
                    yield from inserted("I")
                    yield current, None, audit
                current, audit, at, state, pieces = (null, conv), "", 0, 0, []
            if kind == 0:
                pieces.append(text)
                continue
            if pieces:
                audit, pieces = "".join(pieces), []
            yield from inserted("I")
            edit, at = audit[at], at + 1
            if edit == "K":
                yield current, role, text
                state = KEPT[role[0]][state]
            elif edit == "R":
                yield current, ROLES[state], text
                state = DUE[state]
    if current is not None:
        yield from inserted("I")
        yield current, None, audit


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One audit and one hash for each conversation."""
    sha, mark, done = hashlib.sha256(), "", []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(done, columns=["_null", "_conv", "audit", "repaired_sha256"])

    for key, role, text in _edited(batches):
        if role is not None:
            sha.update(f"{mark}{role}:{text}".encode("utf-8", "surrogatepass"))
            mark = "\n"
            continue
        done.append((*key, text, sha.hexdigest()))
        sha, mark = hashlib.sha256(), ""
        if len(done) == 500:
            yield frame()
            done.clear()
    yield frame()


def _as_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done, number = [], 0
    for key, role, text in _edited(batches):
        if role is None:
            number = 0
            continue
        done.append((*key, number, role, text))
        number += 1
        if len(done) == 500:
            yield pd.DataFrame(done, columns=["_null", "_conv", "number", "role", "text"])
            done.clear()
    yield pd.DataFrame(done, columns=["_null", "_conv", "number", "role", "text"])


def _stream(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits and rows of each conversation in one sorted stream; the texts are shuffled here only."""
    edits = audits.select(*KEY, F.lit(0).alias("_kind"), F.col("nr").alias("turn"), F.lit(None).cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(None).cast("string").alias("_h"))
    texts = _with_key(rows).select(*KEY, F.lit(1).alias("_kind"), "turn", "role", "text", _row_hash().alias("_h"))
    both = edits.unionAll(texts).repartition(*KEY).sortWithinPartitions(*KEY, "_kind", F.col("turn").asc_nulls_first(), "role", "_h")
    return both.select(*KEY, "_kind", "role", "text")


def _planned(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The codes of the rows, the chunks and the audits of the chunks."""
    coded = staged(spark, ordered_codes(spark, rows), "repair-codes")
    cut = staged(spark, chunks(spark, coded), "repair-chunks")
    return coded, cut, staged(spark, least_audits(spark, cut), "repair-audits")


def repaired_rows(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(conv_id, number, role, text): rows (no nulls in role and text) after their cheapest edits."""
    _, _, audits = _planned(spark, rows)
    stream = _stream(rows, audits)
    out = stream.mapInPandas(_as_rows, f"{_key_schema(stream)}, number long, role string, text string")
    return out.select(F.when(~F.col("_null"), F.col("_conv")).alias("conv_id"), "number", "role", "text")


def repair(spark: SparkSession, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ``ids`` (conv_id) the faults of its ``rows``, the
    cost and the letters of its cheapest edits, and the hash of the repaired rows."""
    coded, cut, audits = _planned(spark, rows)

    def count(fault: int, name: str) -> Column:
        return F.sum((F.col("fault") == fault).cast("long")).alias(name)

    faults = coded.groupBy(*KEY).agg((F.max("turn") - F.min("turn") + 1).alias("_span"),
                                     count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(CUT, "truncated"))
    turns = coded.select(*KEY, "turn").distinct().groupBy(*KEY).agg(F.count("turn").alias("_turns"))
    pairs = F.zip_with("initials", F.slice("initials", F.lit(2), F.size("initials")), lambda a, b: F.concat(a, b))
    wrong = F.size(F.filter(F.slice(pairs, F.lit(1), F.size("initials") - 1), lambda p: ~p.isin("su", "ua", "au")))
    edges = cut.select(*KEY, "nr", F.element_at("initials", 1).alias("_first"), F.element_at("initials", -1).alias("_last"), wrong.alias("_wrong"))
    # pairs across chunks: the last initial with the first of the next chunk
    after = edges.select(*KEY, (F.col("nr") - 1).alias("nr"), F.col("_first").alias("_then"))
    across = F.coalesce(~F.concat("_last", "_then").isin("su", "ua", "au"), F.lit(False)).cast("int")
    illegal = edges.join(after, [*KEY, "nr"], "left").groupBy(*KEY).agg(F.sum(F.col("_wrong") + across).alias("illegal"))
    costs = audits.groupBy(*KEY).agg(F.sum("cost").alias("cost"))
    stream = _stream(rows, audits)
    hashed = stream.mapInPandas(_hashed, f"{_key_schema(stream)}, audit string, repaired_sha256 string")
    out = _with_key(ids.select("conv_id").distinct())
    for part in (faults, turns, illegal, costs, hashed):
        out = out.join(part, KEY, "left")
    numbers = {"gaps": F.col("_span") - F.col("_turns")} | {c: F.col(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in numbers.items()],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
