"""Conversation structure repair: the cheapest edits that give every dialogue
the shape ``(s?(ua)+)?`` (an optional system turn, then user and assistant in
turn), by iterative-deepening A*.

The rows of a conversation are visited in order; at each one the search may
Delete, Insert a turn before it, Keep or Rerole, always tried in this (ASCII)
order, depth first, under a bound on the cost. The bound starts at the costs no
repair avoids and rises to the least cost that went over it. Failed states go
to a transposition table, as the least budget that could still succeed, so a
state is not searched twice for nothing. The first accepting path is the answer.

A conversation is cut into segments of ``SEGMENT`` rows, so that one of any
length is many small rows. Which cost is left after a segment depends on four
states only (nothing yet, or the last role), so the costs of the segments behind
are combined as 4 x 4 min-plus matrices, level by level; each segment is then
searched from each state it may begin in, and the states are chained forward
the same way. Every row of a segment ends in a letter other than I, so no
segment's edits are the start of others', and the ASCII-least edits of the whole
are those of its segments.
"""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import exact_rank
from .common import materialize

#: Rows of a segment, and segments combined at a time.
SEGMENT, FAN = 64, 256
#: States: nothing kept yet, or the last role is system, user, assistant. The
#: role that an Insert or Rerole gives in each, and the state it leads to.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = [USER, USER, ASSISTANT, USER]
KEPT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
CHANGE, DELETE = 3, 4
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
NEVER = 1 << 60
#: Cost of closing a dialogue from each state, by inserts after its last row.
CLOSING = [0, 2 * CHANGE, CHANGE, 0]
SPACE = " \t\n\x0b\x0c\r"


def search(roles: str, faults: list[int], start: int, after: list[int] | None) -> tuple[int, int, list[str], list[str]]:
    """The cheapest, then ASCII-least, edits of rows with these role initials
    and faults, from state ``start``. ``after`` is the cost left behind the rows
    by state; None: the dialogue ends here. Returns cost (of the edits), end
    state, and per row its letters (inserts before it first) and the initials
    of the roles they give (``-`` for none); a last entry holds closing inserts."""
    n = len(roles)
    least = [min(after) if after else 0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least[i] = least[i + 1] + (DELETE if faults[i] in (BLANK, DUPLICATE) else CHANGE if faults[i] == TRUNCATED else 0)
    need: dict[tuple[int, int, int], int] = {}
    over = 0

    def visit(i: int, state: int, inserts: int, budget: int) -> list | None:
        """A path within ``budget`` as (row, letter, given role, new state), last first."""
        nonlocal over
        spot = (i, state, inserts)
        if i == n and (state in (BEGIN, ASSISTANT) if after is None else after[state] <= budget):
            return []
        outer, over = over, NEVER
        if i == n and after is not None:
            over = after[state] - budget
        else:
            for letter, role, to, cost in moves(i, state, inserts):
                child = (i, to, inserts + 1) if letter == "I" else (i + 1, to, 0)
                more = cost + need.get(child, least[child[0]]) - budget
                if more > 0:
                    over = min(over, more)
                    continue
                found = visit(*child, budget - cost)
                if found is not None:
                    found.append((i, letter, role, to))
                    return found
        need[spot] = budget + over
        over = min(outer, over)
        return None

    def moves(i, state, inserts):
        free = i < n and faults[i] not in (BLANK, DUPLICATE)
        extra = CHANGE if free and faults[i] == TRUNCATED else 0
        if i < n:
            yield "D", "-", state, DELETE
        if inserts < 2:  # a third would come back to a state that was there before
            yield "I", "-sua"[GIVEN[state]], GIVEN[state], CHANGE
        if free:
            if (state, roles[i]) in KEPT:
                yield "K", "-", KEPT[state, roles[i]], extra
            yield "R", "-sua"[GIVEN[state]], GIVEN[state], CHANGE + extra

    bound = least[0]
    while True:
        over = NEVER
        path = visit(0, start, 0, bound)
        if path is not None:
            break
        bound += over
    letters, given, end, cost = [""] * (n + 1), [""] * (n + 1), start, 0
    for i, letter, role, to in reversed(path):
        letters[i] += letter
        given[i] += role
        end = to
        cost += {"D": DELETE, "I": CHANGE, "K": 0, "R": CHANGE}[letter]
        cost += CHANGE if letter in "KR" and faults[i] == TRUNCATED else 0
    return cost, end, letters, given


def costs_through(roles: str, faults: list[int]) -> list[int]:
    """The least cost from each state before these rows to each state right
    after the last one, as 16 numbers."""
    out = []
    for start in range(4):
        at = [NEVER] * 4
        at[start] = 0
        for role, fault in zip(roles, faults, strict=True):
            for _ in range(2):
                for s in range(4):
                    at[GIVEN[s]] = min(at[GIVEN[s]], at[s] + CHANGE)
            to = [x + DELETE for x in at]
            if fault not in (BLANK, DUPLICATE):
                extra = CHANGE if fault == TRUNCATED else 0
                for s in range(4):
                    to[GIVEN[s]] = min(to[GIVEN[s]], at[s] + CHANGE + extra)
                    if (s, role) in KEPT:
                        to[KEPT[s, role]] = min(to[KEPT[s, role]], at[s] + extra)
            at = [min(x, NEVER) for x in to]
        out += at
    return out


def _then(first: list[int], second: list[int]) -> list[int]:
    return [min(NEVER, *(first[4 * s + m] + second[4 * m + t] for m in range(4))) for s in range(4) for t in range(4)]


def _costs_after(parts: list[list[int]], after: list[int]) -> list[list[int]]:
    """The cost left behind each part, of parts in order before ``after``."""
    out = []
    for p in reversed(parts):
        out.append(after)
        after = [min(NEVER, *(p[4 * s + t] + after[t] for t in range(4))) for s in range(4)]
    return out[::-1]


def _states_before(parts: list[list[int]], state: list[int]) -> list[list[int]]:
    out = []
    for p in parts:
        out.append(state)
        state = [p[state[0]]]
    return out


def _follow(first: list[int], second: list[int]) -> list[int]:
    return [second[x] for x in first]


def _chained(parts: DataFrame, one: Callable, spread: Callable, edge: list[int]) -> DataFrame:
    """``conv_id, seg, edge``: what ``spread`` gives each segment's ``part`` of
    a conversation, from ``edge`` at its end or beginning. Parts are combined
    ``FAN`` at a time (``one``), so that no task holds a conversation."""
    def combined(col: pa.Array) -> pa.Array:
        out = []
        for ps in col.to_pylist():
            whole = ps[0]["part"]
            for p in ps[1:]:
                whole = one(whole, p["part"])
            out.append(whole)
        return pa.array(out, pa.list_(pa.int64()))

    def dealt(col: pa.Array, edges: pa.Array) -> pa.Array:
        out = [[{"seg": p["seg"], "edge": e} for p, e in zip(ps, spread([p["part"] for p in ps], edge), strict=True)]
               for ps, edge in zip(col.to_pylist(), edges.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("seg", pa.int64()), ("edge", pa.list_(pa.int64()))])))

    up = F.floor(F.col("seg") / FAN).alias("up")
    listed = F.array_sort(F.collect_list(F.struct("seg", "part"))).alias("parts")
    levels = [parts.select("conv_id", "seg", "part")]
    while (levels[-1].agg(F.max("seg")).first()[0] or 0) >= FAN:
        level = levels[-1].groupBy("conv_id", up).agg(listed)
        levels.append(materialize(level.select("conv_id", F.col("up").alias("seg"),
                                               F.arrow_udf(combined, "array<long>")("parts").alias("part")), "repair-level"))
    split = F.arrow_udf(dealt, "array<struct<seg:long,edge:array<long>>>")
    first = F.array(*[F.lit(x).cast("long") for x in edge])
    out = levels[-1].groupBy("conv_id").agg(listed).select("conv_id", F.explode(split("parts", first)).alias("e"))
    for level in reversed(levels[:-1]):
        known = out.select(F.col("conv_id").alias("c"), F.col("e.seg").alias("s"), F.col("e.edge").alias("edge"))
        low = level.groupBy("conv_id", up).agg(listed)
        out = (low.join(known, low["conv_id"].eqNullSafe(known["c"]) & (F.col("up") == F.col("s")))
               .select("conv_id", F.explode(split("parts", "edge")).alias("e")))
    return out.select("conv_id", "e.seg", "e.edge")


def ordered_rows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", copies_col: str | None = None) -> DataFrame:
    """The distinct rows ``conv_id, turn, role, text, copies, pos`` of all
    conversations as a written table, ``pos`` their place in the order of
    conversation, turn (null first), role and text. ``copies_col`` counts a
    row several times."""
    d = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
                     (F.lit(1) if copies_col is None else F.col(copies_col)).cast("long").alias("copies"))
    d = d.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    d = d.withColumn("digest", F.unhex(F.sha2("text", 256)))
    return exact_rank(d, ["conv_id", "turn", "role", "text"], rank_col="pos")


def segments(rows: DataFrame) -> DataFrame:
    """``conv_id, seg, n_segs, start, items``: the rows of each conversation by
    ``SEGMENT`` at a time, as (pos, role initial, fault, copies) in order."""
    bare = F.rtrim("text", F.lit(SPACE))
    blank = bare == ""
    own = materialize(rows.select(
        "conv_id", "pos", "role", "digest", "copies", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~blank & ~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut")), "repair-rows")
    # rows with the same role and text: all but the first repeat it
    first = own.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    size = own.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("n_rows"))
    size = size.select(F.col("conv_id").alias("c2"), "start", F.ceil(F.col("n_rows") / SEGMENT).alias("n_segs"))
    d = own.join(first, own["conv_id"].eqNullSafe(F.col("c")) & (own["role"] == F.col("r")) & (own["digest"] == F.col("d")), "left")
    d = d.join(size, d["conv_id"].eqNullSafe(F.col("c2")))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0))
    item = F.struct("pos", F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("-").alias("initial"),
                    fault.alias("fault"), "copies")
    d = d.select("conv_id", F.floor((F.col("pos") - F.col("start")) / SEGMENT).alias("seg"), "n_segs", "start", item.alias("item"))
    return materialize(d.groupBy("conv_id", "seg", "n_segs", "start").agg(F.array_sort(F.collect_list("item")).alias("items")),
                       "repair-segments")


def edits(segs: DataFrame) -> DataFrame:
    """``segs`` with ``cost`` and per row ``letters`` and ``given`` (one entry
    more for closing inserts), as ``search`` has them."""
    def through(items: pa.Array) -> pa.Array:
        return pa.array([costs_through("".join(x["initial"] for x in xs), [x["fault"] for x in xs]) for xs in items.to_pylist()],
                        pa.list_(pa.int64()))

    kind = pa.list_(pa.struct([("cost", pa.int64()), ("end", pa.int64()), ("letters", pa.list_(pa.string())),
                               ("given", pa.list_(pa.string()))]))

    def searched(items: pa.Array, seg: pa.Array, after: pa.Array) -> pa.Array:
        out = []
        for xs, s, left in zip(items.to_pylist(), seg.to_pylist(), after.to_pylist(), strict=True):
            roles, faults = "".join(x["initial"] for x in xs), [x["fault"] for x in xs]
            found = [search(roles, faults, start, left) for start in (range(4) if s else range(1))]
            out.append([dict(zip(("cost", "end", "letters", "given"), f, strict=True)) for f in found])
        return pa.array(out, kind)

    many = F.col("n_segs") > 1
    parts = materialize(segs.where(many).select("conv_id", "seg", F.arrow_udf(through, "array<long>")("items").alias("part")),
                        "repair-costs")
    after = materialize(_chained(parts, _then, _costs_after, CLOSING), "repair-after").toDF("c", "s", "edge")
    d = segs.join(after, many & segs["conv_id"].eqNullSafe(after["c"]) & (segs["seg"] == after["s"]), "left")
    # only the last segment closes the dialogue
    d = d.withColumn("after", F.when(F.col("seg") < F.col("n_segs") - 1, F.col("edge")))
    find = F.arrow_udf(searched, "array<struct<cost:long,end:long,letters:array<string>,given:array<string>>>")
    d = materialize(d.withColumn("found", find("items", "seg", "after")).drop("c", "s", "edge", "after"), "repair-found")
    ends = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get("found", i)["end"], F.get("found", F.lit(0))["end"]))
    begun = _chained(d.where(many).select("conv_id", "seg", ends.alias("part")), _follow, _states_before, [BEGIN])
    begun = begun.toDF("c", "s", "edge")
    d = d.join(begun, many & d["conv_id"].eqNullSafe(begun["c"]) & (d["seg"] == begun["s"]), "left")
    at = F.coalesce(F.get("edge", F.lit(0)), F.lit(0)).cast("int")
    return materialize(d.withColumn("f", F.get("found", at)).select(
        "conv_id", "seg", "n_segs", "start", "items", "f.cost", "f.letters", "f.given"), "repair-edits")


def repaired_rows(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The repaired conversations as rows ``conv_id, pos, part, edit, role,
    text``, in order by ``pos, part`` within a conversation (I, K or R)."""
    at = F.posexplode(F.arrays_zip("letters", "given"))
    each = done.select("conv_id", (F.col("start") + F.col("seg") * SEGMENT).alias("from"), F.size("items").alias("n"), at.alias("i", "e"))
    each = each.select("conv_id", (F.col("from") + F.col("i")).alias("pos"), (F.col("i") == F.col("n")).alias("closing"),
                       "e.letters", "e.given").where("letters != ''")
    # closing inserts follow the last row, under its position
    each = each.withColumn("pos", F.when(F.col("closing"), F.col("pos") - 1).otherwise(F.col("pos")))
    each = each.where("letters != 'D'")
    text = rows.select("pos", F.col("role").alias("old"), F.col("text").alias("said"))
    each = each.join(text, "pos").select(
        "conv_id", "pos", "closing", "letters", "given", "old", "said", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("k"))
    letter, given = (F.substr(F.col(c), F.col("k"), F.lit(1)) for c in ("letters", "given"))
    role = F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("old"))
    return each.select("conv_id", "pos", (F.col("k") + F.when(F.col("closing"), 3).otherwise(0)).alias("part"), letter.alias("edit"),
                       role.alias("role"), F.when(letter == "I", "").otherwise(F.col("said")).alias("text")).where("edit != 'D'")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each repaired conversation's ``role:text`` lines.
    Its rows pass through one task in order, none of them is held."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, ids, out = None, None, [], []
        names = ["conv_id", "sha256"]
        of = None
        for b in batches:
            of = b.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        ids.append(now)
                        out.append(state.hexdigest())
                    now, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "replace"))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, of), pa.array(out)], names)
                ids, out = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([state.hexdigest()])], names)

    order = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "part")
    return order.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def report(rows: DataFrame, done: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation of ``convs`` (column ``conv_id``): ``gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    faults = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
    x = F.explode("items").alias("x")
    copies = F.col("x.copies")

    def counted(name):
        hit = F.when(F.col("x.fault") == faults[name], 1).otherwise(0)
        if name == "blank":
            hit = hit * copies
        if name == "duplicate":  # further copies repeat a row, unless blank
            hit = hit + F.when(F.col("x.fault") != BLANK, copies - 1).otherwise(0)
        return F.sum(hit).alias(name)

    found = done.select("conv_id", x).groupBy("conv_id").agg(*[counted(n) for n in faults])

    def bad(a, b):
        return F.when(F.concat(a, b).isin("su", "ua", "au"), 0).otherwise(1)

    pairs = F.arrays_zip(F.slice("items", 1, F.size("items") - 1).alias("a"), F.slice("items", 2, F.size("items")).alias("b"))
    inside = F.aggregate(F.when(F.size("items") > 1, pairs), F.lit(0).cast("long"), lambda s, p: s + bad(p["a"]["initial"], p["b"]["initial"]))
    again = F.aggregate("items", F.lit(0).cast("long"), lambda s, i: s + i["copies"] - 1)
    own = F.transform(F.arrays_zip("items", F.slice("letters", 1, F.size("items")).alias("l")),
                      lambda p: F.concat(p["l"], F.repeat(F.lit("D"), (p["items"]["copies"] - 1).cast("int"))))
    text = F.concat(F.array_join(own, ""), F.element_at("letters", -1))
    segs = done.select("conv_id", "seg", "cost", text.alias("audit"), (F.coalesce(inside, F.lit(0)) + again).alias("illegal"),
                       again.alias("again"), F.get("items", F.lit(0))["initial"].alias("head"), F.element_at("items", -1)["initial"].alias("tail"), "n_segs")
    # the last row of a segment and the first of the next
    a = segs.where("n_segs > 1").select(F.col("conv_id").alias("c"), (F.col("seg") + 1).alias("s"), F.col("tail").alias("before"))
    segs = segs.join(a, (F.col("seg") > 0) & segs["conv_id"].eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")), "left").select(
        "conv_id", "seg", "cost", "audit", "again",
        (F.col("illegal") + F.when(F.col("before").isNull(), 0).otherwise(bad(F.col("before"), F.col("head")))).alias("illegal"))
    whole = segs.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), (F.sum("cost") + DELETE * F.sum("again")).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    wide = F.col("turn").cast("decimal(38,0)")
    gaps = (rows.select("conv_id", "turn").distinct().groupBy("conv_id")
            .agg(F.coalesce(F.max(wide) - F.min(wide) + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))
    out = convs.select("conv_id").distinct()
    for i, part in enumerate((gaps, found, whole, digests(repaired_rows(rows, done)))):
        part = part.withColumnRenamed("conv_id", f"c{i}")
        out = out.join(part, out["conv_id"].eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all conversations (``ordered_rows``) and their ``edits``.

    Rows are taken by turn (null first), role, text; a repeated row is a copy,
    all but the first are duplicates. Null roles and texts are one space; a role
    that does not start with s, u or a (an empty one, too) cannot be kept as it
    is; null conversation ids are one conversation; extra columns are ignored;
    an empty table gives empty results. No group is gathered: a conversation of
    any length is many segments. The audit of ``report`` is one string a
    conversation (a letter a row), and its digest reads the rows in order, as
    SHA-256 must."""
    rows = ordered_rows(turns, conv_col, turn_col, role_col, text_col, copies_col)
    return rows, edits(segments(rows))
