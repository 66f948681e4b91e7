"""Chat formatting by quotation linking.

Messages are split into lines with their quote level (the number of leading
``>``). The sentences of each level are normalised and hashed, and joined to the
first message of the same conversation that has them in its own words. A message
replies to the message whose sentences it quotes most, at its outermost level
that links; without a link, to the message before it. A message that replies
to an earlier one than that opens a branch: it and what follows it stand right
after the message it answers. The result is every message without its quotes, its parent, and its place.

All of it is DataFrame functions. Order within a conversation comes from one
range-partitioned sort, with the open branch carried from part to part, so a
conversation of any length is spread over many tasks; sentences are reduced to
one row for each (conversation, hash) before the join.

Defined cases: a null text is empty; a null role is kept; messages with a null
conv_id form one conversation, those with a null turn come first in theirs; rows
that repeat are messages of their own, ordered by role and text and then
arbitrarily among equals; an empty table gives an empty table; other columns are ignored.

A quote of a sentence that its author wrapped over line ends links, and so do quotes of one character: own words are
hashed both with their line ends and with lines joined. Texts of any
length are parsed whole; of sources quoted equally often the latest is answered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlake.llm._shared import Scratch, with_rank

#: Fixed patterns: a quote prefix, and the line that introduces a quote.
QUOTE = r"^ ?(?:> ?)+"
INTRO = r"^\s*(?:On|Am|Le|El) .*(?:wrote|schrieb.*|a écrit|escribió)\s*:\s*$"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add ``content`` (own words) and ``quoted``: an array of (level, s) sentences, and ``own``: the
    sentences of the content, split at line ends and also with lines joined, as those of quotes are."""
    split = "filter(transform(split({}, '[.!?\\n]+', -1), s -> trim(regexp_replace(lower(s), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '))), s -> length(s) > 0)"
    lines = f"transform(split(coalesce({text}, ''), '\\n', -1), l -> struct(length(regexp_replace(regexp_extract(l, {_sql(QUOTE)}, 0), '[^>]', '')) as level, l as line))"
    out = messages.withColumn("__l", F.expr(lines))
    own = f"filter(__l, (x, i) -> x.level = 0 and not (get(__l, i + 1).level is not null and get(__l, i + 1).level > 0 and x.line rlike {_sql(INTRO)}))"
    out = out.withColumn("content", F.expr(f"regexp_replace(array_join(transform({own}, x -> x.line), '\\n'), '^\\\\s+|\\\\s+$', '')"))
    # neighbouring lines of a level make one passage; others are kept apart by a line end
    passage = "array_join(transform(filter(transform(__l, (x, i) -> struct(x.level as level, x.line as line, coalesce(get(__l, i - 1).level, 0) as before)), x -> x.level = v), x -> concat(if(x.before = v, ' ', '\\n'), regexp_replace(x.line, " + _sql(QUOTE) + ", ''))), '')"
    joined = "replace(content, '\\n', ' ')"
    levels = "array_sort(array_distinct(filter(transform(__l, x -> x.level), v -> v > 0)))"
    quoted = f"flatten(transform({levels}, v -> transform({split.format(passage)}, s -> struct(v as level, s as s))))"
    return out.withColumn("quoted", F.expr(quoted)).withColumn("own", F.expr(f"array_union({split.format('content')}, {split.format(joined)})")).drop("__l")


def thread(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """conv_id, turn, role, parent_turn, position, n_quotes, n_linked, content."""
    scratch = scratch or Scratch(messages.sparkSession)
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    ranked = with_rank(scratch, rows, [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")], "at", keep_part=True)
    parsed = scratch.write(parse(ranked).drop("text"), "parsed")

    quotes = parsed.select("at", "conv_id", "turn", F.explode("quoted").alias("q")).select("at", "conv_id", "turn", "q.level", F.xxhash64("q.s").alias("h"))
    asked = quotes.select("conv_id", "h").distinct()
    first = parsed.select("conv_id", "turn", F.explode("own").alias("s")).select("conv_id", "turn", F.xxhash64("s").alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("source"))
    first = first.withColumnRenamed("conv_id", "c").withColumnRenamed("h", "g")
    linked = asked.join(first, asked["conv_id"].eqNullSafe(first["c"]) & (asked["h"] == first["g"])).select(F.col("conv_id").alias("c"), "g", "source")
    hits = quotes.join(linked, quotes["conv_id"].eqNullSafe(linked["c"]) & (quotes["h"] == linked["g"])).where("source < turn")
    votes = hits.groupBy("at", "level", "source").agg(F.count("*").alias("n"))
    # outermost level first, then the most sentences, then the latest message
    reply = votes.groupBy("at").agg(F.max(F.struct((-F.col("level")).alias("l"), "n", "source"))["source"].alias("source"), F.sum("n").alias("n_linked"))

    before = parsed.select((F.col("at") + 1).alias("at"), F.col("conv_id").alias("__conv"), F.col("turn").alias("before"))
    known = parsed.withColumn("n_quotes", F.size("quoted").cast("long")).drop("quoted", "own").join(before, "at", "left").join(reply, "at", "left")
    before = F.when(F.col("__conv").eqNullSafe(F.col("conv_id")), F.col("before"))
    known = known.withColumn("before", before).withColumn("parent_turn", F.coalesce("source", "before"))
    opens = F.col("source").isNotNull() & ~F.col("source").eqNullSafe(F.col("before"))
    known = scratch.write(known.withColumn("branch", F.when(opens, F.struct(F.col("source").alias("anchor"), F.col("turn").alias("start")))), "known")

    # the open branch runs on within a conversation, from part to part of the sort
    inside = Window.partitionBy("__part", "conv_id").orderBy("at")
    known = known.withColumn("branch", F.last("branch", True).over(inside))
    ends = known.groupBy("__part").agg(F.max_by(F.struct("conv_id", "branch"), "at").alias("e")).select("__part", F.col("e.conv_id").alias("end_conv"), F.col("e.branch").alias("end_branch"))
    parts = known.groupBy("__part").agg(F.min_by(F.struct("conv_id"), "at")["conv_id"].alias("first_conv"))
    # one row for each part of the sort: what is open in a conversation that began before it
    earlier = ends.join(parts, "__part").select("__part", "end_conv", "end_branch", "first_conv")
    opened = earlier.select("__part", F.col("first_conv").alias("end_conv"), F.lit(None).cast("struct<anchor: bigint, start: bigint>").alias("end_branch"), F.lit(0).alias("own"))
    opened = opened.union(earlier.select("__part", "end_conv", "end_branch", F.lit(1))).withColumn("carried", F.last("end_branch", True).over(Window.partitionBy("end_conv").orderBy("__part", "own").rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.where("own = 0 and carried is not null").select("__part", F.col("end_conv").alias("__conv2"), "carried")
    known = known.join(F.broadcast(opened), ["__part"], "left")
    known = known.withColumn("branch", F.coalesce("branch", F.when(F.col("__conv2").eqNullSafe(F.col("conv_id")), F.col("carried"))))

    flat = known.select("conv_id", "turn", "role", "parent_turn", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "content", "at", F.coalesce("branch.anchor", "turn").alias("k1"), F.coalesce("branch.start", F.lit(-1)).alias("k2"))
    key = [F.col(c).asc_nulls_first() for c in ("conv_id", "k1", "k2", "at")]
    placed = scratch.write(with_rank(scratch, flat, key, "place"), "placed")
    start = placed.groupBy(F.col("conv_id").alias("__conv")).agg(F.min("place").alias("__start"))
    out = placed.join(start, placed["conv_id"].eqNullSafe(start["__conv"]))
    return out.select("conv_id", "turn", "role", "parent_turn", (F.col("place") - F.col("__start")).alias("position"), "n_quotes", "n_linked", "content")


def render(threaded: DataFrame) -> DataFrame:
    """Add ``formatted``: each message in a plain chat template."""
    return threaded.withColumn("formatted", F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("content"), F.lit("\n")))
