"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Equal lines collapse first. A distinct line of length l is split into k + 1 even segments; a line within k edits of it
keeps one of them, shifted by a bounded offset. So the segments of each length are an index that lines of length l to
l + k probe with the substrings at those offsets. Keys that nobody else holds are dropped before rows with line ids
move. Pairs that meet are compared by a parity signature of their characters (k edits flip at most 2k bits) and are
then verified by Spark's banded edit distance with a bound.

A key that very many lines hold, as variants of a template do, is no place to meet. Its lines go on to a further level
without the segment, and without what all of them begin and end with; what is left of two near lines is within k edits
too, so it is split into segments in its turn, and lines meet only where these agree as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, id_filter, maybe_in, skew_lookup, stored

PER_PART = 2000  # index rows of a key that a part of its probes meets
PAIRS_AT_MOST = 4_000_000  # pairs that may meet by a key; beyond, its lines are split further
LEAST_CHARS = 1  # default floor of near-duplicates; lines of k or fewer code points, all within k edits of each other, have none anyhow


def _keyed(items: DataFrame, k: int) -> DataFrame:
    """(iid, key, how): the keys of each item (iid, gid, s, len) for items of more than k code points; ``how`` packs what _how has.

    Index keys are the item's own segments and serve as probes of its own length too; the others only probe. The shapes
    of keys are exploded before a key is computed: one small expression, which the JVM compiles, instead of a long one
    for all of them at once, which it would interpret.
    """
    shapes = []
    for i in range(k + 1):
        for shorter in range(k + 1):
            for shift in range(-k, k + 1):
                # Edits left of the segment at most i, right of it at most k - i: else another segment matches too.
                if abs(shift) <= i and abs(shift - shorter) <= k - i:
                    shapes.append(f"named_struct('i', {i}, 'shorter', {shorter}, 'shift', {shift})")
    m = k + 1
    each = items.select("iid", "gid", "s", "len", F.expr(f"explode(array({', '.join(shapes)}))").alias("p"))
    # Segment i of a line of that length: the last ones are longer by one.
    each = each.select("iid", "gid", "s", "len", "p.*").withColumn("of", F.expr("len - shorter")).withColumn("longer", F.expr(f"i - {m} + of % {m}"))
    at = each.withColumn("at", F.expr(f"i * (of div {m}) + greatest(0, longer) + shift")).withColumn("size", F.expr(f"of div {m} + if(longer >= 0, 1, 0)"))
    fits = at.filter(f"at >= 0 and size > 0 and of > {k} and at + size <= len")
    return fits.select("iid", F.expr("xxhash64(gid, of, i, substring(s, cast(at as int) + 1, cast(size as int)))").alias("key"), _how("shorter = 0 and shift = 0", "shorter", "at", "size"))


def _how(index: str, shorter: str, at: str, size: str) -> Column:
    """One number for all four; a line has at most 2**28 code points."""
    return F.expr(f"cast({shorter} as long) | if({index}, 16L, 0L) | shiftleft(cast({size} as long), 5) | shiftleft(cast({at} as long), 34)").alias("how")


#: SQL of what ``how`` packs.
INDEX, SHORTER, SIZE, AT = "(how & 16L = 16L)", "how & 15L", "cast(shiftright(how, 5) & 536870911L as int)", "cast(shiftright(how, 34) as int)"


def _short_keyed(items: DataFrame, k: int) -> DataFrame:
    """The same for items of at most 2k code points, by what is left after at most k deletions: those of at most k are met by all within k edits."""
    less = "array(s)"
    for _ in range(k):
        less = f"array_distinct(flatten(transform({less}, x -> concat(array(x), if(x = '', array(), transform(sequence(1, length(x)), i -> concat(substring(x, 1, i - 1), substring(x, i + 1))))))))"
    each = items.filter(F.col("len") <= 2 * k).select("iid", "gid", "len", F.explode(F.expr(less)).alias("x"))
    return each.select("iid", F.xxhash64("gid", F.lit("less"), "x").alias("key"), _how(f"len <= {k}", f"if(len <= {k}, 0, 1)", "0", "0"))


def _further(hot: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the next level: each line of a hot key without the segment, and without the ends that all lines of the key share."""
    rest = F.concat(F.substring("s", F.lit(1), F.col("at")), F.expr("substring(s, at + size + 1)"))
    left = hot.select("iid", F.col("key").alias("gid"), F.expr(AT).alias("at"), F.expr(SIZE).alias("size")).join(items.select("iid", "lid", "s", "sign"), "iid").select("gid", "lid", "sign", rest.alias("s"))
    left = stored(left.distinct(), "residues")
    ends = left.groupBy("gid").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), F.min(F.reverse("s")).alias("rlo"), F.max(F.reverse("s")).alias("rhi"), F.min(F.length("s")).alias("least"))
    # What the least and the greatest text both begin with, all texts between them begin with.
    same = lambda a, b: F.expr(f"transform(array(struct(split({a}, '') as a, split({b}, '') as b)), x -> coalesce(array_min(filter(sequence(0, least), i -> coalesce(get(x.a, i) <> get(x.b, i), true))), least))[0]")
    ends = ends.select("gid", "n", "least", same("lo", "hi").alias("p"), same("rlo", "rhi").alias("q"))
    ends = stored(ends.select("gid", "n", F.least("p", "least").alias("p"), F.least("q", F.col("least") - F.least("p", "least")).alias("q")), "ends")
    each = skew_lookup(left, ends, "gid", "n", left.count())
    each = each.select("gid", "lid", "sign", F.expr("substring(s, p + 1, length(s) - p - q)").alias("s"))
    out = stored(each.select(F.monotonically_increasing_id().alias("iid"), "*", F.length("s").alias("len")), "items")
    discard(left, ends)
    return out


def line_links(lines: DataFrame, k: int, least_chars: int = LEAST_CHARS, pairs_at_most: int = PAIRS_AT_MOST) -> DataFrame:
    """(a, b, distance) with a < b of rows (lid, line, len): distinct lines of 1 to k edits.

    Lines of k or fewer code points, or of fewer than least_chars, are left out.
    """
    long_ = lines.filter(F.col("len") >= max(least_chars, k + 1))
    sign = F.expr("aggregate(split(s, ''), 0L, (a, c) -> if(c = '', a, a ^ shiftleft(1L, pmod(ascii(c), 63))))")
    whole = long_.select(F.col("lid").alias("iid"), F.lit(0).cast("long").alias("gid"), "lid", F.col("line").alias("s"), "len")
    items, texts, levels, scratch = whole, None, [], []
    while True:
        keyed = _keyed(items, k) if texts is None else _keyed(items, k).unionByName(_short_keyed(items, k))
        # Somebody's segment must be met by somebody else: two index keys, or an index key and a probe that is no index key.
        counts = keyed.groupBy("key").agg(F.count_if(F.expr(INDEX)).alias("n_index"), F.count("*").alias("n"), F.max(F.expr(SIZE)).alias("size"))
        hot = (F.col("n_index") * F.col("n") > pairs_at_most) & (F.col("size") > 0)
        live = counts.filter("n_index > 0 and n > 1").select("key", "n", hot.alias("hot"), F.ceil(F.col("n_index") / PER_PART).cast("int").alias("parts"))
        live = stored(live, "live_keys")
        sums = live.agg(F.count("*"), F.sum("n"), F.max("hot")).first()
        pages, slot = id_filter(live.select("key"), sums[0])
        held = stored(skew_lookup(maybe_in(keyed, F.col("key"), pages, slot), live, "key", "n", sums[1] or 0).drop("n"), "held_keys")
        if texts is None:
            ids = held.select("iid").distinct()
            pages, slot = id_filter(ids, ids.count())
            # Signatures are for lines that somebody may meet only: most lines have no key in common with another.
            items = texts = stored(maybe_in(whole, F.col("iid"), pages, slot).withColumn("sign", sign), "live_lines")
        signed = held.filter("not hot").join(items.select("iid", "lid", "sign"), "iid")
        # Only short residues have keys of several parts: a key's probes are dealt to them, each meets the whole index.
        index = signed.filter(INDEX).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lid").alias("b"), F.col("sign").alias("sb"))
        probe = signed.select("key", F.pmod(F.xxhash64("lid"), "parts").cast("int").alias("part"), F.expr(SHORTER).alias("shorter"), F.col("lid").alias("a"), F.col("sign").alias("sa"))
        meet = ((F.col("shorter") > 0) & (F.col("a") != F.col("b")) | (F.col("a") > F.col("b"))) & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * k)
        levels.append(probe.join(index, ["key", "part"]).filter(meet).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        scratch += [live, held, items]
        if not sums[2]:
            break
        items = _further(held.filter("hot"), items)
    pairs = levels[0]
    for level in levels[1:]:
        pairs = pairs.unionByName(level)
    pairs = pairs.distinct().join(texts.select(F.col("lid").alias("a"), F.col("s").alias("la")), "a").join(texts.select(F.col("lid").alias("b"), F.col("s").alias("lb")), "b")
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.levenshtein("la", "lb", k).alias("distance"))
    out = stored(found.filter("distance > 0"), "line_links")
    discard(*scratch)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 2, least_chars: int = LEAST_CHARS, pairs_at_most: int = PAIRS_AT_MOST) -> DataFrame:
    """(row, doc_id, line_no, class_id, n_links, kept) for each line of docs, and a row with line_no null for a text without.

    Lines are what line feeds part, without white space at their ends; empty ones don't count but keep their numbers,
    from 0. Lines are linked if they are equal, or if both have more than k code points, least_chars at least, and are within k edits; a class is
    a connected component. The first line of a class by (doc_id, line_no) is kept; null ids come last. n_links counts the
    near links of a line's distinct text. ``row`` tells rows of docs apart that repeat an id; between them the first by
    row stays. Null texts count as empty, other columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    numbered = F.expr(r"filter(transform(split(text, '\n'), (x, i) -> named_struct('no', i, 'line', trim(both ' \t\r\u000C' from x))), x -> x.line <> '')")
    each = rows.select("row", "doc_id", F.explode_outer(numbered).alias("x")).select("row", "doc_id", F.col("x.no").alias("line_no"), F.col("x.line").alias("line"))
    each = each.select("*", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))  # 128 bits name a line: the second hash has another seed
    places = stored(each.select("row", "doc_id", "line_no", "k1", "k2"), "places")
    real = each.filter("line_no is not null")
    lines = stored(real.groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("lid"), "k1", "k2", "line", F.length("line").alias("len"), "n"), "lines")
    links = line_links(lines.select("lid", "line", "len"), k, least_chars, pairs_at_most)
    label = components(links).withColumnsRenamed({"id": "lid", "component": "class_id"})
    degree = links.select(F.explode(F.array("a", "b")).alias("lid")).groupBy("lid").agg(F.count("*").alias("n_links"))
    named = lines.select("lid", "k1", "k2", "n").join(label.join(degree, "lid"), "lid", "left")
    named = stored(named.select("k1", "k2", "n", F.coalesce("class_id", "lid").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    discard(lines, links)
    total = named.agg(F.sum("n")).first()[0] or 0
    # One key column for the skew-safe join; k2 tells collisions of k1 apart.
    by_key = named.withColumn("k", F.struct("k1", "k2")).drop("k1", "k2")
    found = skew_lookup(places.filter("line_no is not null").withColumn("k", F.struct("k1", "k2")).drop("k1", "k2"), by_key, "k", "n", total).drop("k", "n")
    found = stored(found, "classed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "line_no")
    classes = stored(found.groupBy("class_id").agg(F.count("*").alias("n"), F.min(order).alias("first")), "classes")
    kept = skew_lookup(found, classes, "class_id", "n", total)
    kept = kept.select("row", "doc_id", "line_no", "class_id", "n_links", ((F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"))
    none = places.filter("line_no is null").select("row", "doc_id", "line_no", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("kept"))
    return kept.unionByName(none)


def by_document(lines: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, removed array<int>) for each document of line_dedup's result."""
    gone = F.col("kept") == F.lit(False)
    return lines.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("line_no").alias("n_lines"),
        F.count_if(gone).alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.array_sort(F.collect_list(F.when(gone, F.col("line_no")))).alias("removed"),
    ).drop("row")
