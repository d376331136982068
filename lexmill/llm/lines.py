"""Fuzzy line dedup with built-in functions only: SimHash, pigeonhole blocks, edit similarity.

A line is normalised (lower case, anything but letters and digits becomes one space).  Equal normalised lines
are one line with its first occurrence; the SimHash of its words has a bit set where over half of the word hashes have it.
With ``blocks`` parts of the 64 bits, lines whose fingerprints differ in at most ``radius`` bits agree in at least
``blocks - radius`` parts, so each line is dealt to one bucket per choice of that many parts.  Pairs within the radius
are verified by edit similarity on the normalised lines, links are connected, and the first occurrence (doc, line number) of each group stays.

Not all pairs of a bucket are made.  First every line is compared with the bucket's smallest line only, which
is linear; then only lines that are not connected yet are compared with each other, and once more where a
verification failed.  So a large group of like lines costs as many comparisons as it has lines and not their square, and no
link between groups is lost.

Lines travel as digests, counters as packed longs: texts are shuffled once, to fetch the candidates' lines.  Joins that
meet all lines are shuffled at every size, because no side has a bound.

Defined cases: a NULL or empty text has no lines; lines without letters or digits are left alone; rows with a NULL id
are left alone and make no line a repetition; rows with one id are one document, so their equal lines share a decision;
very long lines are compared whole; other columns are ignored by ``duplicate_lines`` and kept by ``drop_lines``.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.exprs import let
from lexmill.llm.common import drop_scratch, pin, read, signed
from lexmill.llm.components import components

#: What is not one blank between words: most words are one blank apart already, so that hardly anything is replaced.
SEPARATOR = r"[^\p{L}\p{N}](?:[^\p{L}\p{N}]+|(?<! ))"
SEED = 42
BITS = 64
RADIUS, BLOCKS = 2, 4
SIMILARITY = 0.8
#: Bits of a packed counter, and the words of a line that it can count.
FIELD = 16
MANY_WORDS = 32767
#: Words whose hashes are added up before they are counted, and the planes of such a sum with the power of two that a bit of each stands for.
RUN = 7
PLANES = (("c0", 0), ("d0", 1), ("d1", 2))
#: Words that are looked ahead for the next common word of two lines.
AHEAD = 3


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SEPARATOR, " "))


def _ones(field: int) -> int:
    """The lowest bit of each field but the top one, which is handled apart because longs have a sign."""
    return sum(1 << at for at in range(0, BITS - field, field))


def _lifted(count: Column, n: Column, field: int) -> Column:
    """One bit per field of ``count``: whether the field is over n / 2.

    Adding the same number to every field lifts exactly those counts into the field's highest bit.
    """
    top = BITS - field
    lift = F.lit((1 << (field - 1)) - 1).cast("long") - F.shiftright(n, 1).cast("long")
    low = F.shiftright(count.bitwiseAND(F.lit((1 << top) - 1)) + lift * F.lit(_ones(field)), field - 1).bitwiseAND(F.lit(_ones(field)))
    return low.bitwiseOR(F.shiftleft(F.shiftright(F.shiftright(count, top) + lift, field - 1), top))


def _place(h: Column, at: int, field: int) -> Column:
    """Bits at, at + field, ... of a hash, each at the foot of its field."""
    return F.shiftright(h, at).bitwiseAND(F.lit(_ones(field) | 1 << (BITS - field)))


def _added(a: str, b: str, c: str, name: str) -> list[Column]:
    """The sum of three planes, bit by bit: what stays in the place, and what is carried to the next one."""
    x, y, z = F.col(a), F.col(b), F.col(c)
    differ = x.bitwiseXOR(y)
    return [differ.bitwiseXOR(z).alias(f"{name}0"), x.bitwiseAND(y).bitwiseOR(differ.bitwiseAND(z)).alias(f"{name}1")]


def majority(counts: list[Column], n: Column, field: int) -> Column:
    """The fingerprint from packed counts of ``n`` hashes."""
    bits = (F.shiftleft(_lifted(count, n, field), at) for at, count in enumerate(counts))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _long_line(words: Column) -> Column:
    """The fingerprint of a line of very many words, counted in fields of 32 bits within the row."""

    def counted(hashes: Column, at: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda total, h: total + _place(h, at, 32))

    def of(hashes: Column) -> Column:
        return majority([counted(hashes, at) for at in range(32)], F.size(hashes), 32)

    return let(F.transform(words, lambda word: F.xxhash64(word)), of)


def with_simhash(marked: DataFrame) -> DataFrame:
    """(doc_id, line_no, k1, k2, fp) of rows (row, doc_id, line_no, norm, k1, k2).

    Words are opened in runs of seven, whose hashes are added up bit by bit into three planes; the planes' bits are counted per
    line, four counters of ``FIELD`` bits packed in a long.  A task counts whole lines, so one small row per line is shuffled.
    An empty line has no words and no row.
    """
    words = marked.select("row", "doc_id", "line_no", "k1", "k2", F.split("norm", " ").alias("words"))
    few = F.size("words") <= MANY_WORDS
    words = words.select(
        "row", "doc_id", "line_no", "k1", "k2", "words", F.size("words").alias("n"),
        F.when(~few, _long_line(F.col("words"))).alias("long_fp"),
    )
    # For a bare column the optimizer adds a filter on its size, which would cut every line into words once more.
    runs = F.sequence(F.lit(0), F.when(few, F.col("n") - 1).otherwise(0), F.lit(RUN))
    opened = words.withColumn("at", F.explode(runs)).where(F.get("words", "at") != "")
    line = ["row", "line_no", "doc_id", "k1", "k2", "n", "long_fp"]
    hashes = [F.when(F.col("at") + to < F.col("n"), F.xxhash64(F.get("words", F.col("at") + to))).otherwise(0).alias(f"h{to}") for to in range(RUN)]
    opened = opened.select(*line, *hashes)
    opened = opened.select(*line, "h6", *_added("h0", "h1", "h2", "a"), *_added("h3", "h4", "h5", "b"))
    opened = opened.select(*line, "a1", "b1", *_added("a0", "b0", "h6", "c"))
    opened = opened.select(*line, "c0", *_added("a1", "b1", "c1", "d"))
    counts = [F.sum(reduce(Column.bitwiseOR, (F.shiftleft(_place(F.col(plane), at, FIELD), to) for plane, to in PLANES))).alias(f"count{at}") for at in range(FIELD)]
    # All that a line has is part of its key: further aggregates would make the loop too large to be compiled.
    counted = opened.groupBy(*line).agg(*counts)
    fp = F.coalesce("long_fp", majority([F.col(f"count{at}") for at in range(FIELD)], F.col("n"), FIELD))
    return counted.select("doc_id", "line_no", "k1", "k2", fp.alias("fp"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, line_no, norm) of every line; ``norm`` is empty where it has neither letters nor digits."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).where("doc_id is not null")
    lines = rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("row", "doc_id", "line_no", normalised(F.col("line")).alias("norm"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines with the digest (k1, k2) of their normalised form."""
    return _lines(docs, id_col, text_col).select(
        "row", "doc_id", "line_no", "norm", F.xxhash64("norm").alias("k1"), F.xxhash64("norm", F.lit(SEED)).alias("k2")
    )


def _buckets(fp: Column, radius: int, blocks: int) -> tuple[Column, list[int]]:
    bounds = [BITS * at // blocks for at in range(blocks + 1)]
    masks = [((1 << high) - 1) & ~((1 << low) - 1) for low, high in zip(bounds, bounds[1:])]
    chosen = [signed(sum(parts)) for parts in combinations(masks, blocks - radius)]
    return F.array(*(F.xxhash64(F.lit(at), fp.bitwiseAND(F.lit(mask))) for at, mask in enumerate(chosen))), chosen


def _alike(left: Column, right: Column, similarity: float) -> Column:
    """Edit similarity (one minus edits over the longer length) of at least ``similarity``."""
    longer = F.greatest(F.length(left), F.length(right))
    allowed = F.floor(longer * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    near = F.abs(F.length(left) - F.length(right)) <= allowed

    def within(middles: Column) -> Column:
        a, b = middles["a"], middles["b"]
        # The distance is looked for in a band no wider than what is allowed; -1 stands for more.
        alike = F.call_function("levenshtein", a, b, allowed) >= 0
        # No more edits than characters, nor than word by word: where these suffice, no table is filled.
        few = F.greatest(F.length(a), F.length(b)) <= allowed
        return F.when(few | (_word_edits(F.split(a, " "), F.split(b, " ")) <= allowed), True).otherwise(alike)

    return near & let(_middles(F.split(left, " "), F.split(right, " ")), within)


def _word_edits(left: Column, right: Column) -> Column:
    """Edits of one way to turn a line's words into another's, found in one pass over them: never fewer than the edit distance.

    Each word with the blank behind it is kept, goes, comes or turns into the other line's word.  Where two words differ, the next
    ``AHEAD`` words of either line tell whether some of them were put in.
    """

    def walk(words: Column) -> Column:
        a, b = words["a"], words["b"]

        def step(state: Column, at: Column) -> Column:
            return let(
                F.struct(F.get(a, at).alias("x"), F.get(b, state["to"]).alias("y"), state["to"].alias("to"), state["edits"].alias("edits")),
                lambda s: _step(a, b, at, s),
            )

        start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("edits"))
        rest = lambda s: s["edits"] + _size_of(_from(b, s["to"]))
        return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, rest)

    return let(F.struct(left.alias("a"), right.alias("b")), walk)


def _step(a: Column, b: Column, at: Column, s: Column) -> Column:
    def then(to: Column, edits: Column) -> Column:
        return F.struct(to.alias("to"), (s["edits"] + edits).alias("edits"))

    gone = then(s["to"], F.length(s["x"]) + 1)
    steps = F.when(s["x"] == s["y"], then(s["to"] + 1, F.lit(0))).when(s["y"].isNull(), gone)
    for n in range(1, AHEAD + 1):
        come = _size_of(F.slice(b, s["to"] + 1, F.lit(n)))
        steps = steps.when(s["x"] == F.get(b, s["to"] + n), then(s["to"] + n + 1, come)).when(s["y"] == F.get(a, at + n), gone)
    return steps.otherwise(then(s["to"] + 1, F.levenshtein(s["x"], s["y"])))


def _size_of(words: Column) -> Column:
    """Characters of the words, each with a blank."""
    return F.aggregate(words, F.lit(0), lambda total, word: total + F.length(word) + 1)


def _middles(left: Column, right: Column) -> Column:
    """What is left of two lines without the words that both begin or end with.

    The edit distance of the lines is that of the rest, for these words can stay as they are.  Each side keeps
    a word at least, so that no blank between words is lost.
    """

    def ahead(both: Column) -> Column:
        shorter = F.least(F.size(both["a"]), F.size(both["b"]))
        differ = F.zip_with(F.slice(both["a"], F.lit(1), shorter), F.slice(both["b"], F.lit(1), shorter), lambda x, y: x != y)
        first = F.array_position(differ, True).cast("int")
        same = F.when(first == 0, shorter - 1).otherwise(F.least(first - 1, shorter - 1))
        return let(same, lambda n: F.struct(_from(both["a"], n).alias("a"), _from(both["b"], n).alias("b")))

    def behind(both: Column) -> Column:
        return let(F.struct(F.reverse(both["a"]).alias("a"), F.reverse(both["b"]).alias("b")), ahead)

    def joined(both: Column) -> Column:
        return F.struct(*(F.array_join(F.reverse(both[side]), " ").alias(side) for side in "ab"))

    return let(let(let(F.struct(left.alias("a"), right.alias("b")), ahead), behind), joined)


def _from(items: Column, n: Column) -> Column:
    return F.slice(items, n + 1, F.size(items))


def duplicate_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no) of every line that repeats an earlier one, exactly or nearly."""
    spark = docs.sparkSession
    marked = _marked(docs, id_col, text_col)
    places = pin(with_simhash(marked), dictionary=False)
    first = F.min(F.struct("doc_id", "line_no")).alias("first")
    distinct = pin(
        places.groupBy("k1", "k2")
        .agg(first, F.min("fp").alias("fp"), F.count(F.lit(1)).alias("n"))
        .withColumn("line", F.monotonically_increasing_id()),
        dictionary=False,
    )
    keys, masks = _buckets(F.col("fp"), radius, blocks)
    dealt = distinct.select("line", "fp", F.explode(keys).alias("key"))
    leaders = dealt.groupBy("key").agg(
        F.min("line").alias("leader"), F.min_by("fp", "line").alias("leader_fp"), F.count(F.lit(1)).alias("n")
    )
    leaders = pin(leaders.where("n > 1").drop("n"), dictionary=False)
    members = pin(dealt.join(leaders.hint("merge"), "key"), dictionary=False)
    drop_scratch(spark, leaders)
    within = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius

    def across(rooted: DataFrame) -> DataFrame:
        """Pairs within the radius, in buckets that still hold several groups, whose groups differ."""
        rooted = rooted.withColumnRenamed("node", "line")
        known = members.select("key", "line", "fp").join(rooted, "line", "left").withColumn("root", F.coalesce("root", "line"))
        known = pin(known, dictionary=False)
        several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
        left = pin(known.join(pin(several.select("key"), dictionary=False), "key"), dictionary=False)
        right = left.select("key", F.col("line").alias("line2"), F.col("fp").alias("fp2"), F.col("root").alias("root2"))
        differ = F.col("fp").bitwiseXOR(F.col("fp2"))
        # A pair may meet in several buckets and counts in the first: no distinct is needed.
        first = F.coalesce(
            *(F.when(differ.bitwiseAND(F.lit(mask)) == 0, F.xxhash64(F.lit(at), F.col("fp").bitwiseAND(F.lit(mask)))) for at, mask in enumerate(masks))
        )
        pairs = left.join(right, "key").where((F.col("line") < F.col("line2")) & (F.col("root") != F.col("root2")))
        pairs = pairs.where(within("fp", "fp2")).where(F.col("key") == first)
        pairs = pin(pairs.select(F.col("line2").alias("a"), F.col("line").alias("b")))
        drop_scratch(spark, known, left)
        return pairs

    to_leader = members.where("line <> leader").where(within("fp", "leader_fp"))
    to_leader = to_leader.select(F.col("line").alias("a"), F.col("leader").alias("b")).distinct()
    # Candidates: every line with its leaders, and pairs that these do not connect.
    starts = pin(to_leader)
    candidates = pin(starts.unionByName(across(components(starts))))
    ends = candidates.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    texts = _texts(docs, id_col, text_col, distinct, ends)
    links = pin(_verified(candidates, texts, similarity))
    # Where a candidate failed, lines that it held together are compared with each other as well; all
    # of them have their text here already.
    rooted = components(links)
    further = across(rooted)
    drop_scratch(spark, members)
    # The groups that the links make stand for them.
    held = rooted.select(F.col("node").alias("a"), F.col("root").alias("b"))
    more = _verified(further.join(candidates, ["a", "b"], "left_anti"), texts, similarity)
    groups = pin(components(held.unionByName(more)).withColumnRenamed("node", "line"))
    drop_scratch(spark, starts, candidates, further, texts, links)

    # Only lines that are linked, or stand at several places, can repeat an earlier one.
    grouped = pin(distinct.join(groups.hint("merge"), "line").select("line", "root", "first"))
    kept = pin(grouped.groupBy("root").agg(F.min("first").alias("kept")))
    of_group = pin(grouped.join(kept, "root").select("line", "kept"))
    drop_scratch(spark, groups, grouped, kept)
    several = distinct.join(of_group.hint("merge"), "line", "left").where((F.col("n") > 1) | F.col("kept").isNotNull())
    of_line = pin(several.select("k1", "k2", F.coalesce("kept", "first").alias("kept")))
    drop_scratch(spark, distinct, of_group)
    told = places.select("k1", "k2", "doc_id", "line_no").join(of_line.hint("merge"), ["k1", "k2"])
    repeats = told.where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("line_no") != F.col("kept.line_no")))
    return repeats.select(
        "doc_id", "line_no", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line_no").alias("kept_line_no")
    ).distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str, distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, norm) of the wanted lines, read again from their first document."""
    places = distinct.join(wanted.hint("merge"), "line").select("line", "first.doc_id", "first.line_no")
    per_doc = pin(places.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("places")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = let(
        F.split("text", "\n"),
        lambda lines: F.transform("places", lambda at: F.struct(at["line"].alias("line"), normalised(F.get(lines, at["line_no"])).alias("norm"))),
    )
    # Places of a part of the documents are held, so that their texts need no sort.
    found = rows.join(per_doc.hint("shuffle_hash"), "doc_id").select(F.explode(picked).alias("place"))
    # Rows that share an id may hold other lines at this place; the digest names the right one.
    checked = found.select("place.line", "place.norm").where("norm <> ''")
    own = distinct.select("line", "k1", "k2")
    checked = checked.withColumn("k1", F.xxhash64("norm")).withColumn("k2", F.xxhash64("norm", F.lit(SEED)))
    texts = pin(checked.join(own, ["line", "k1", "k2"]).dropDuplicates(["line"]).select("line", "norm"))
    drop_scratch(docs.sparkSession, per_doc)
    return texts


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    left = texts.select(F.col("line").alias("a"), F.col("norm").alias("left"))
    right = texts.select(F.col("line").alias("b"), F.col("norm").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(_alike(F.col("left"), F.col("right"), similarity)).select("a", "b")


def drop_lines(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines; no row goes, and other columns stay as they are."""
    gone = repeats.groupBy(F.col("doc_id").alias("_lines_of")).agg(F.collect_set("line_no").alias("_lines_gone"))
    gone = pin(gone.withColumn("_lines_gone", F.map_from_arrays("_lines_gone", F.transform("_lines_gone", lambda _: F.lit(True)))))
    joined = docs.join(gone, F.col(id_col).cast("long") == F.col("_lines_of"), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, at: ~F.map_contains_key("_lines_gone", at))
    text = F.when(F.col("_lines_of").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)


def op1_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of the documents that repeats an earlier line, and the occurrence that stays."""
    return duplicate_lines(read(spark, sf_dir, "documents"))
