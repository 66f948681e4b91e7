"""License scans by diagonal voting.

Every rolling word ``K``-gram hash of every text is joined with the positions of
the same grams in the templates. A hit of template position p at text word i
votes for diagonal i - p; a phrase that stands in the text puts all its
votes on one diagonal, and one with words put in or left out on neighbouring ones. Votes are
summed by diagonal, and neighbouring diagonals of one template that follow each
other in the text are merged. A span is verified before it is accepted: every hit's
words are those of the template, and only the longest chain of hits counts whose places
and text words both rise, each step on the same or a neighbouring diagonal, so that a
part found twice counts once. The chain must cover enough of the template: all of it, in
place, for base phrases, titles and licence identifiers. A span of the method's own templates
that lies within another one is dropped, so "attribution noncommercial" is not also "attribution".

The template table is fixed (a few hundred positions), so it is broadcast; what
is shuffled are hits alone and one row a document. Grams of two very common words vote for nothing.

Defined cases: a null text is empty, with no words and labels ''; rows that
repeat are scanned alike; texts are scanned whole; an empty table gives an empty
table; input columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed pattern of a word, in lower-cased text.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 2
#: Fixed base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: The method's own templates: label and words.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "creative commons attribution non commercial"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "creative commons attribution share alike"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "creative commons zero"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
)
#: Fixed titles of licences, and their identifiers in files ("SPDX-License-Identifier: ..."). They are short, so every word has to stand in its place.
TITLES = (
    ("apache-2.0", "apache license 2 0"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("gpl-2.0", "gnu gpl v2"),
    ("gpl-2.0", "gnu gpl version 2"),
    ("gpl-3.0", "gnu gpl v3"),
    ("gpl-3.0", "gnu gpl version 3"),
    ("isc", "isc license"),
    ("mit", "mit license"),
    ("mit", "released under mit"),
    ("mit", "licensed under mit"),
    ("mpl-2.0", "mozilla public license 2 0"),
)
IDENTIFIERS = (
    ("agpl", "agpl 3 0"),
    ("apache-2.0", "apache 2 0"),
    ("bsd", "bsd 2 clause"),
    ("bsd", "bsd 3 clause"),
    ("cc-by", "cc by 4 0"),
    ("cc-by-nc", "cc by nc 4 0"),
    ("cc-by-sa", "cc by sa 4 0"),
    ("cc0", "cc0 1 0"),
    ("gpl-2.0", "gpl 2 0"),
    ("gpl-3.0", "gpl 3 0"),
    ("isc", "isc"),
    ("lgpl", "lgpl 2 1"),
    ("lgpl", "lgpl 3 0"),
    ("mit", "mit"),
    ("mpl-2.0", "mpl 2 0"),
)
SHORT = TITLES + tuple((label, f"spdx license identifier {name}") for label, name in IDENTIFIERS)
COMMON = frozenset("a and any are by for in is no not of or other the this to use with without you that may be at on as it".split())
#: Share of a template's votes that a merged span must hold; how far neighbouring diagonals may lie apart.
COVER, SHIFT = 0.85, 3
#: Length of the longest chain of hits; a step spans a template and SHIFT words at most, so only such a tail is kept.
_REACH = max(len(phrase.split()) for _, phrase in TEMPLATES) + SHIFT
_LINKS = f"x -> x.p < h.p and x.i < h.i and abs((h.i - h.p) - (x.i - x.p)) <= {SHIFT}"
_CHAIN = f"""aggregate(array_sort(hits), named_struct('best', 0, 'tail', cast(array() as array<struct<i: int, p: int, n: int>>)),
  (s, h) -> named_struct('best', greatest(s.best, coalesce(array_max(s.tail.n), 0)), 'tail', concat(filter(s.tail, x -> x.i >= h.i - {_REACH}), array(named_struct('i', h.i, 'p', h.p, 'n', 1 + coalesce(array_max(filter(s.tail, {_LINKS}).n), 0))))),
  s -> greatest(s.best, coalesce(array_max(s.tail.n), 0)))"""
_DOCUMENT = -1  # the template number of the row that stands for a document without hits


def template_rows() -> list[tuple[int, str, str, bool, bool, int, int]]:
    """(template, gram, label, is base, has to stand whole, position, votes of the whole)."""
    rows = []
    for t, (label, phrase, base, whole) in enumerate([(lab, p, True, True) for p, lab in BASE] + [(lab, p, False, True) for lab, p in SHORT] + [(lab, p, False, False) for lab, p in TEMPLATES]):
        words = phrase.split()
        grams = [(i, words[i : i + K]) for i in range(len(words) - K + 1)]
        grams = [(i, g) for i, g in grams if whole or not COMMON.issuperset(g)]
        rows += [(t, " ".join(g), label, base, whole, i, len(grams)) for i, g in grams]
    return rows


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    spark = docs.sparkSession
    gram = F.expr("xxhash64(split(gram, ' ')[0], split(gram, ' ')[1])").alias("gram")
    templates = spark.createDataFrame(template_rows(), "t int, gram string, label string, base boolean, whole boolean, place int, votes int").select("t", gram, F.split("gram", " ").alias("pair"), "label", "base", "whole", "place", "votes")
    # a document stands in the stream once as the gram 'null', so one scan gives both hits and counts
    templates = templates.union(spark.range(1).selectExpr(f"{_DOCUMENT}", "xxhash64('document', null)", "cast(null as array<string>)", "cast(null as string)", "false", "false", "0", "0"))

    text = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))  # the only non-ASCII letter that becomes ASCII is the Kelvin sign; no base phrase has a k
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.regexp_extract_all(text, F.lit(LICENSE_WORD), F.lit(0)).alias("words"))
    rows = rows.select("row", "doc_id", "words", F.expr("cast(size(words) as bigint)").alias("n_words"), F.expr("concat(array(xxhash64('document', null)), if(size(words) < 2, cast(array() as array<bigint>), transform(sequence(0, size(words) - 2), i -> xxhash64(get(words, i), get(words, i + 1)))))").alias("grams"))
    grams = rows.select("row", "doc_id", "n_words", "words", F.posexplode("grams").alias("i", "gram"))
    # equal hashes are not yet equal words
    same = (F.col("t") == _DOCUMENT) | F.expr("get(words, i - 1) = pair[0] and get(words, i) = pair[1]")
    hits = grams.join(F.broadcast(templates), "gram").where(same).withColumn("i", F.col("i") - 1).drop("words", "pair", "gram")

    # one shuffle: the rows of a document stay together from here on
    hits = hits.repartition("row")
    # votes by diagonal
    diagonals = hits.groupBy("row", "doc_id", "n_words", "t", "label", "base", "whole", "votes", (F.col("i") - F.col("place")).alias("diagonal")).agg(F.collect_list("place").alias("places"), F.min("i").alias("a"), (F.max("i") + K).alias("b"))
    # merge neighbours: spans of one template in text order, a step of the diagonal of at most SHIFT;
    # each diagonal of a phrase that has to stand whole stands alone
    order = Window.partitionBy("row", "t").orderBy("a", "diagonal")
    step = F.col("whole") | (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SHIFT) | (F.col("a") > F.lag("b").over(order) + SHIFT)
    runs = diagonals.withColumn("run", F.sum(F.coalesce(step, F.lit(True)).cast("int")).over(order))
    spans = runs.groupBy("row", "doc_id", "n_words", "t", "label", "base", "whole", "votes", "run").agg(F.flatten(F.collect_list(F.expr("transform(places, p -> struct(cast(p + diagonal as int) as i, p))"))).alias("hits"), F.min("a").alias("a"), F.max("b").alias("b"))
    # verify: the hits in order, after a first look at their number
    least = F.when(F.col("whole"), 1.0).otherwise(COVER)
    spans = spans.where((F.col("t") == _DOCUMENT) | (F.size("hits") / F.col("votes") >= least))
    cover = F.when(F.col("t") == _DOCUMENT, 0.0).otherwise(F.expr(_CHAIN) / F.col("votes"))
    spans = spans.withColumn("cover", cover).where((F.col("t") == _DOCUMENT) | (F.col("cover") >= least))
    # of the method's own spans, one that lies within another says nothing of its own
    before = Window.partitionBy("row").orderBy("a", F.desc("votes"), F.desc("b"), "t").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(~F.col("base") & (F.col("t") != _DOCUMENT), F.col("b"))).over(before) >= F.col("b"), F.lit(False))
    spans = spans.withColumn("inside", inside).where(F.col("base") | ~F.col("inside") | (F.col("t") == _DOCUMENT))

    is_base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("a"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("a"))).cast("long").alias("last_word"),
            joined(F.when(is_base, F.col("label"))).alias("base_labels"),
            joined("label").alias("labels"),
            F.max("cover").alias("score"),
        )
        .drop("row")
    )
