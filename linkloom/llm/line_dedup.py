"""Line deduplication by a segment-partition edit join, on DataFrame functions alone.

A line of a document is dropped when a document with a smaller id has the same line or, for lines of min_chars and more,
one within `threshold` edits. Two strings that near share one of threshold + 1 even segments, shifted by a few
characters at most. So each distinct line stands under the signatures of its segments and of the substrings that can
match the segments of a line of its own or a slightly smaller length (the multi-match-aware positions); what meets is
verified by a banded bit-parallel edit distance.

Copies of a line are merged by map-side partial aggregates before anything is joined. One shuffle of (signature, line)
finds the signatures that two lines have; all further steps, and all texts that move, are those of such lines.

A line needs one witness, not all partners. An edit changes the counts of at most two characters, so of threshold * 2 + 1
groups of characters one has the same counts in both lines of a near pair: signatures are told apart by the counts of
each group in turn. Each line is first held against the earliest line of each of these; only lines that are still undecided meet
all others, and then as pairs whose counts agree. Where many lines meet an undecided one, as numbered lines do, they
are told apart once more: the digits alone of near lines are no more than `threshold` edits apart either, so they share a
segment of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WHITE_SPACE, cut, may_be_in

THRESHOLD = 2
MIN_CHARS = 20
#: Fixed value: characters that are counted, those that tell most first, dealt to the groups in turn. Others only count less.
COUNTED = " 0123456789etaoinshrdlucmfwygpbvk.,jxqz-"
#: Counts that a number holds, one a byte.
BYTES = 8
#: Lines of a key beyond which it is told apart by digits.
CROWD = 32
#: A hot line's rows are dealt to so many tasks.
SALTS = 16


def _segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of the i-th (from 0) of `parts` even segments; the later ones take the remainder."""
    short = F.floor(length / parts)
    first_long = parts - length % parts
    start = i * short + F.greatest(F.lit(0), F.lit(i) - first_long) + 1
    return start.cast("int"), (short + (F.lit(i) >= first_long).cast("int")).cast("int")


def index_signatures(line: Column, threshold: int) -> list[Column]:
    """Signatures of a line's own segments; they are also among its probe_signatures."""
    length = F.length(line)
    cut_out = [_segment(length, i, threshold + 1) for i in range(threshold + 1)]
    return [F.xxhash64(F.lit(i), length, line.substr(start, size)) for i, (start, size) in enumerate(cut_out)]


def probe_signatures(line: Column, threshold: int) -> list[Column]:
    """Signatures under which a line of the same length or up to threshold characters less may be indexed."""
    out = []
    for shorter in range(threshold + 1):
        length = F.length(line) - shorter
        for i in range(threshold + 1):
            start, size = _segment(length, i, threshold + 1)
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            out += [F.xxhash64(F.lit(i), length, line.substr(start + shift, size)) for shift in range(low, high + 1)]
    return out


def digit_signatures(line: Column, threshold: int) -> Column:
    """array of (signature, indexed) of a line's digits; indexed are those of its own segments.

    Of near lines, one has an indexed signature that the other has too. Fewer digits than segments tell a line apart by their number.
    """
    digits = F.regexp_replace(line, "[^0-9]", "")
    few = threshold + 1
    entry = lambda signature, indexed: F.struct(signature.alias("signature"), F.lit(indexed).alias("indexed"))
    probes = []
    for shorter in range(threshold + 1):
        length = F.length(digits) - shorter
        probes.append(F.when((length >= 0) & (length < few), entry(F.xxhash64(F.lit(-1), length), shorter == 0)))
        for i in range(threshold + 1):
            start, size = _segment(length, i, threshold + 1)
            low, high = max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i))
            probes += [F.when(length >= few, entry(F.xxhash64(F.lit(i), length, digits.substr(start + shift, size)), shorter == 0 and shift == 0)) for shift in range(low, high + 1)]
    return F.array_distinct(F.array_compact(F.array(*probes)))


def character_counts(line: Column, groups: int) -> list[Column]:
    """Per group of characters a number with the count of each, modulo 256, in a byte of its own."""
    out = []
    for group in range(groups):
        counts = F.lit(0).cast("long")
        for k, c in enumerate(COUNTED[group::groups][:BYTES]):
            counts = counts.bitwiseOR(F.shiftleft((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(255).cast("long"), 8 * k))
        out.append(counts)
    return out


def counts_apart(a: list[Column], b: list[Column]) -> Column:
    """How far the counts of two lines are apart in all, counting modulo 256: at most twice the edit distance."""
    total = F.lit(0).cast("long")
    for group, (p, q) in enumerate(zip(a, b, strict=True)):
        for k in range(len(COUNTED[group :: len(a)][:BYTES])):
            x, y = (F.shiftright(c, 8 * k).bitwiseAND(255) for c in (p, q))
            total = total + F.least(F.abs(x - y), 256 - F.abs(x - y))
    return total


def within_distance(a: Column, b: Column, threshold: int) -> Column:
    """Whether a and b are at most threshold edits apart, by bit vectors of the 2 * threshold + 1 diagonals around the main one.

    Bit d of a vector stands for row j - threshold + d of column j; vp and vn are the vertical steps up and down. The
    distance is followed along the highest diagonal down to the last row, then along that row. Rows that have left all
    hope behind are passed over. Both strings must be longer than threshold. One-element arrays give intermediate
    results a name, so that each is computed once.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    named = F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t"))
    distance = F.get(F.transform(F.array(named), lambda s: _distance(s["p"], s["t"], k, width, full)), F.lit(0))
    return (F.abs(F.length(a) - F.length(b)) <= k) & (distance <= k)


def _distance(p: Column, t: Column, k: int, width: int, full: int) -> Column:
    m, n = F.size(p), F.size(t)
    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("score"))
    hopeless = 2 * k + n - m

    def column(acc: Column, j: Column) -> Column:
        char = F.get(t, j - 1)
        match = F.lit(0)
        for d in range(width):
            match = match + F.when(F.get(p, j - 1 - k + d) == char, F.lit(1 << d)).otherwise(F.lit(0))
        made = F.struct(match.alias("match"), acc.alias("old"))
        named = F.transform(F.array(made), lambda s: F.struct(s["old"].alias("old"), ((s["match"].bitwiseAND(s["old"]["vp"]) + s["old"]["vp"]).bitwiseXOR(s["old"]["vp"]).bitwiseOR(s["match"]).bitwiseOR(s["old"]["vn"])).bitwiseAND(full).alias("d0")))
        named = F.transform(named, lambda s: F.struct(s["old"]["score"].alias("score"), s["d0"].alias("d0"), s["old"]["vn"].bitwiseOR(F.lit(full) - s["d0"].bitwiseOR(s["old"]["vp"])).alias("hp"), s["d0"].bitwiseAND(s["old"]["vp"]).alias("hn")))

        def next_state(s: Column) -> Column:
            row_bit = F.expr(str(1 << (2 * k - 1)))
            steps_along = j - (m - k) - 1  # columns since the last row was reached, from 0
            mask = F.call_function("shiftright", row_bit, F.greatest(steps_along, F.lit(0)).cast("int"))
            diagonal = s["score"] + F.when(s["d0"].bitwiseAND(1 << (2 * k)) == 0, 1).otherwise(0)
            along = s["score"] + F.when(s["hp"].bitwiseAND(mask) != 0, 1).otherwise(0) - F.when(s["hn"].bitwiseAND(mask) != 0, 1).otherwise(0)
            down = F.shiftright(s["d0"], 1)
            return F.struct(
                s["hn"].bitwiseOR(F.lit(full) - down.bitwiseOR(s["hp"])).alias("vp"),
                down.bitwiseAND(s["hp"]).alias("vn"),
                F.when(j <= m - k, diagonal).otherwise(along).alias("score"),
            )

        return F.when(acc["score"] > hopeless, acc).otherwise(F.get(F.transform(named, next_state), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), n), start, column, lambda acc: acc["score"])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, version, pos, line) of the lines that hold more than white space. Version tells rows apart that repeat an id."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.split(F.col(text_col), "\n").alias("lines"))
    return rows.select("id", "version", F.posexplode("lines").alias("pos", "line")).filter(F.trim(F.col("line"), F.lit(WHITE_SPACE)) != "")


def _hashes(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("g")]


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (h, g), the hashes of each line that is within threshold edits of another whose first document is earlier than its own first."""
    groups = 2 * threshold + 1
    names = [f"c{j}" for j in range(groups)]
    long = lambda rows: rows.filter(F.length("line") >= min_chars)

    # copies of a line have equal signatures: min() keeps them and lets hash aggregates merge the copies map-side
    signatures = probe_signatures(F.col("line"), threshold)
    signed = long(_lines(docs, id_col, text_col)).select("id", *_hashes(), *[s.alias(f"s{n}") for n, s in enumerate(signatures)])
    signed = signed.groupBy("h", "g").agg(F.min("id").alias("id"), *[F.min(f"s{n}").alias(f"s{n}") for n in range(len(signatures))])
    dealt = signed.select("id", "h", F.explode(F.array(*[f"s{n}" for n in range(len(signatures))])).alias("signature")).repartition("signature")
    # of lines with different hashes or first documents; both branches read the same columns of one shuffle
    apart = [F.min(c) != F.max(c) for c in ("h", "id")]
    shared = dealt.groupBy("signature").agg((apart[0] | apart[1]).alias("apart")).filter("apart").select("signature")
    members = cut(dealt.join(shared.hint("shuffle_hash"), "signature", "left_semi"))

    wanted = cut(members.select("id", "h").distinct())
    marked = may_be_in(docs.select(id_col, text_col), F.col(id_col), wanted.select("id"))
    texts = long(_lines(marked, id_col, text_col)).select("id", *_hashes(), "line").join(wanted.hint("shuffle_hash"), ["id", "h"], "left_semi").dropDuplicates(["h", "g"])
    own = F.array(*index_signatures(F.col("line"), threshold))
    texts = cut(texts.select("*", *[c.alias(n) for n, c in zip(names, character_counts(F.col("line"), groups), strict=True)], own.alias("own")))

    told_apart = F.array(*[F.xxhash64("signature", F.lit(j), n) for j, n in enumerate(names)])
    placed = members.join(texts.drop("line").hint("shuffle_hash"), ["id", "h"]).select(F.explode(told_apart).alias("key"), "id", "h", "g", F.array_contains("own", F.col("signature")).alias("indexed"), *names)
    placed = cut(placed)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of line hashes, h and g of the lines b that are near."""
        side = lambda s: texts.select(F.col("h").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("id", "g", "line", *names)])
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("a_id") < F.col("b_id"))
        close = counts_apart([F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names]) <= 2 * threshold
        return both.filter(close & within_distance(F.col("a_line"), F.col("b_line"), threshold)).select(F.col("b").alias("h"), F.col("b_g").alias("g")).distinct()

    first = placed.groupBy("key").agg(F.min("id").alias("first_id"), F.min_by("h", "id").alias("a"))
    with_first = placed.join(first.hint("shuffle_hash"), "key").filter("id > first_id").select("a", F.col("h").alias("b")).distinct()
    decided = cut(verified(with_first))

    undecided = placed.join(decided, ["h", "g"], "left_anti")
    undecided = cut(undecided)
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    crowd = cut(sizes.join(undecided.select("key").distinct().hint("shuffle_hash"), "key", "left_semi").select("key"))

    def by_digits(rows: DataFrame) -> DataFrame:
        """The rows of crowded keys, under each of the key's signatures of digits."""
        there = rows.join(crowd.hint("shuffle_hash"), "key", "left_semi").join(texts.select("id", "h", "line").hint("shuffle_hash"), ["id", "h"])
        each = there.select("*", F.explode(digit_signatures(F.col("line"), threshold)).alias("d"))
        return each.select(F.xxhash64("key", "d.signature").alias("key"), "id", "h", "indexed", F.col("d.indexed").alias("by_digit"), *names)

    def met(lines: DataFrame, others: DataFrame) -> DataFrame:
        """Pairs (a, b) of the hashes of lines and of others that share a key, are in order and have close counts."""
        columns = ("id", "h", "indexed", "by_digit", *names)
        a, b = (rows.select("key", *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s, rows in (("a", lines), ("b", others)))
        close = counts_apart([F.col(f"a_{n}") for n in names], [F.col(f"b_{n}") for n in names]) <= 2 * threshold
        on = (a["key"] == b["key"]) & (F.col("a_id") < F.col("b_id")) & (F.col("a_indexed") | F.col("b_indexed")) & (F.col("a_by_digit") | F.col("b_by_digit")) & close
        return a.join(b, on).select(F.col("a_h").alias("a"), F.col("b_h").alias("b"))

    few = lambda rows: rows.join(crowd.hint("shuffle_hash"), "key", "left_anti").withColumn("by_digit", F.lit(True))
    pairs = met(few(placed), few(undecided)).union(met(by_digits(placed), by_digits(undecided)))
    return decided.union(verified(cut(pairs.distinct())))


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (id, version, pos): the lines of each document that an earlier document has, exactly or nearly; pos counts from 0.

    Lines of white space take no part. Lines of any length are dropped as exact copies; near copies are only lines of
    min_chars code points and more; min_chars must exceed threshold. A line that is a near copy of an earlier document's
    line is dropped even where that one is dropped in turn; lines of one document, and of rows with the same id, are not
    held against each other. Rows without id or text take no part. version is a hash of the whole text.
    """
    near = cut(near_copies(docs, id_col, text_col, threshold, min_chars).withColumn("near", F.lit(True)))
    lines = cut(_lines(docs, id_col, text_col).select("id", "version", "pos", *_hashes()))
    copied = lines.groupBy("h", "g").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id <> last_id").drop("last_id")
    # one verdict a line: later documents lose a copy, all lose a near copy of an earlier document's line
    verdicts = copied.join(near.hint("shuffle_hash"), ["h", "g"], "full").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("salt", F.pmod(F.hash("id", "pos"), F.lit(SALTS)))
    hit = salted.join(verdicts.hint("shuffle_hash"), ["h", "g", "salt"]).filter(F.col("near").isNotNull() | (F.col("id") > F.col("first_id")))
    return hit.select(F.col("id").alias(id_col), "version", "pos")


def _repeats(lines: Column) -> Column:
    """Places at which a line with more than white space stands that the array has further ahead. Sorting with the place keeps this n log n."""
    named = F.array(F.array_sort(F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("at")))))
    blank = lambda x: F.trim(x, F.lit(WHITE_SPACE)) == ""
    again = lambda s: F.transform(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: (F.get(s, k)["line"] == F.get(s, k - 1)["line"]) & ~blank(F.get(s, k)["line"])), lambda k: F.get(s, k)["at"])
    return F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.get(F.transform(named, again), F.lit(0))).otherwise(F.array().cast("array<int>"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, report: bool = False) -> DataFrame:
    """docs with the dropped lines taken out of the text; with report=True, also n_lines and n_dropped.

    Beside the lines of line_verdicts, a line that a document repeats stays where it stands first. Lines of white space
    stay. A null text stays null, with no lines; a text of which no line is left becomes empty. Rows without id only lose
    lines that they repeat themselves. An empty table gives no rows. Columns n_lines and n_dropped are replaced if docs
    has them, with report=True; columns that begin with __line are this function's own.
    """
    dropped = line_verdicts(docs, id_col, text_col, threshold, min_chars).groupBy(F.col(id_col).alias("__line_id"), F.col("version").alias("__line_version")).agg(F.collect_set("pos").alias("__line_dropped"))
    same = (F.col(id_col) == F.col("__line_id")) & (F.xxhash64(text_col) == F.col("__line_version"))
    out = docs.join(cut(dropped).hint("shuffle_hash"), same, "left").withColumn("__lines", F.split(F.col(text_col), "\n"))
    out = out.withColumn("__line_gone", F.array_union(F.coalesce("__line_dropped", F.array().cast("array<int>")), _repeats(F.col("__lines"))))
    gone = F.col("__line_gone")
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    text = F.when(F.size(gone) == 0, F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__lines"), i)), "\n"))
    if report:
        there = F.col(text_col).isNotNull()
        out = out.withColumn("n_lines", F.when(there, F.size("__lines")).otherwise(0).cast("long")).withColumn("n_dropped", F.when(there, F.size(gone)).otherwise(0).cast("long"))
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), text)).drop("__line_id", "__line_version", "__line_dropped", "__line_gone", "__lines")
