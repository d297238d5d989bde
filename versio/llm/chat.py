"""Multi-party chat formatting by perspective rotation, in DataFrame operations.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; the mask marks what the
assistant says. A dialogue is cut into blocks of consecutive rows, by their position, so
that a conversation of any length is many bounded rows; most are one block.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rank import exact_rank

#: Rows of a dialogue in a block.
BLOCK_TURNS = 64
END = "<|end|>\n"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text", system: str = "system", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per conversation, participant and block: ``conv_id, perspective,
    block, from_turn, n_turns, n_rows, text, mask_starts, mask_ends``.

    The dialogue of a perspective is its blocks by ``block``, each of
    ``block_turns`` rows in the order of the conversation (the last may be
    shorter), ``from_turn`` the turn number of the first; mask spans are character offsets into the row's text, end exclusive, and
    cover what the perspective's speaker says with its end mark. Turns are in
    order of number (null first), speaker, text. Speakers are all but ``system``
    and null: the system stays system, a null speaker is a user without a name,
    and neither is a participant, so a conversation of these alone gives no row.
    A repeated row (all four columns alike) is one turn (``n_rows`` counts the
    rows); a null text is empty; rows without a conversation id are one
    conversation (its output is the product of its speakers and rows, as for any); ``<|`` in texts and names is written ``< |``. Extra columns are ignored."""
    d = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                     F.col(speaker_col).cast("string").alias("speaker"), F.coalesce(text_col, F.lit("")).alias("text"))
    d = d.groupBy("conv_id", "turn", "speaker", "text").agg(F.count("*").alias("rows"))
    # positions over all conversations; no window holds one of them
    d = exact_rank(d, ["conv_id", "turn", "speaker", "text"], rank_col="pos")
    start = d.groupBy(F.col("conv_id").alias("c")).agg(F.min("pos").alias("start"))
    d = d.join(start, d["conv_id"].eqNullSafe(start["c"])).drop("c")
    d = d.withColumn("block", F.floor((F.col("pos") - F.col("start")) / block_turns).cast("long")).drop("pos", "start")

    people = (d.where(F.col("speaker").isNotNull() & (F.col("speaker") != system))
              .select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct())
    seen = d.join(people, d["conv_id"].eqNullSafe(people["c"]))
    grouped = seen.groupBy("conv_id", "perspective", "block").agg(
        F.array_sort(F.collect_list(F.struct("turn", "speaker", "text", "rows"))).alias("t"))

    def plain(c):
        return F.replace(c, F.lit("<|"), F.lit("< |"))

    def segment(t):
        own = F.coalesce(t["speaker"] == F.col("perspective"), F.lit(False))
        head = (F.when(own, "<|assistant|>\n").when(t["speaker"] == system, "<|system|>\n")
                .when(t["speaker"].isNull(), "<|user|>\n")
                .otherwise(F.concat(F.lit("<|user name="), plain(t["speaker"]), F.lit("|>\n"))))
        body = F.concat(plain(t["text"]), F.lit(END))
        return F.struct(own.alias("own"), F.length(head).alias("head"), F.length(body).alias("body"),
                        F.concat(head, body).alias("text"), t["rows"].alias("rows"))

    def walk(acc, s):
        """Offsets of the masked spans, and the length so far."""
        start = acc["at"] + s["head"]
        end = start + s["body"]
        return F.struct(end.alias("at"), F.when(s["own"], F.concat(acc["spans"], F.array(F.struct(start.alias("a"), end.alias("b")))))
                        .otherwise(acc["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    out = grouped.withColumn("s", F.transform("t", segment)).withColumn("m", F.aggregate("s", zero, walk, lambda a: a["spans"]))
    return out.select(
        "conv_id", "perspective", "block", F.get("t", F.lit(0))["turn"].alias("from_turn"), F.size("t").alias("n_turns"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["rows"]).alias("n_rows"),
        F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"),
        F.transform("m", lambda x: x["a"]).alias("mask_starts"), F.transform("m", lambda x: x["b"]).alias("mask_ends"))
