"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines are compared in lower case, with single blanks and none at the ends.  Equal lines are one class.  Different
lines are linked if they are within ``LIMIT`` edits and the longer one has ``LEAST`` characters or more.  Classes are
the connected components of the links; of each class the first line (by doc_id, then line number) stays.

The join.  A line of n characters is cut into limit + 1 segments, those of the first half counted from its start,
those of the second half from its end.  With up to *limit* edits there is a segment i that has none, with i edits
before it and limit - i after it at most; so in the other line it stands within min(i, limit - i) of the same place
from that end.  A line's keys are the substrings at those places: 5 for 2 edits.  The length of segments follows from
the line's length with its last binary digits dropped, so lines of about one length share it; at the edges a line
emits keys of both lengths.

Keys of one line only, nearly all, end in a pre-aggregated sum.  The lines of the others are read, and their keys
made again: within a key of up to ``DENSE`` lines all pairs are compared by numbers (lengths, letters); beyond it the
shared segment is cut out, and what is left of the lines, which must be within the limit too, is joined in the same
way within the key, and so on (but not for a key all of whose lines share an earlier one's).  So lines that share long
passages, and differ everywhere in between, make pairs in proportion to those that are alike, not all pairs.  What
passes is verified on the whole lines by bit-parallel edit distance in a band of 2 * limit + 1 diagonals.

Texts are never shuffled: keys and ids are, and the lines of candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored, table
from .components import components

#: Edits, and the characters of the longer line from which they count.
LIMIT, LEAST = 2, 15
#: Ids of so many lines or keys (8 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Lines of a key of which all pairs are compared.
DENSE = 512
#: Symbols whose counts are compared before texts are, in eights: common letters and the digits.
LETTERS = ("entiarso", "hldcum01", "23456789")


def normal(line: Column) -> Column:
    """Lower case, single blanks, none at the ends; tabs and carriage returns are blanks."""
    # `replace` leaves most lines as they are, at the cost of a search; `translate` would rebuild each.
    plain = F.replace(F.replace(line, F.lit("\r"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return F.lower(F.trim(F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, "  +", " ")).otherwise(plain)))


def identity(line: Column) -> Column:
    return F.xxhash64(line)


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), line_no (from 0), line (normalised), id and check (its hashes):
    the lines that are not blank."""
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # Tested before it is normalised, as the planner would normalise twice to filter on the outcome.
    rows = rows.where(F.trim(F.col("line"), F.lit(" \t\r")) != "").withColumn("line", normal(F.col("line")))
    return rows.withColumns({"id": identity(F.col("line")), "check": F.hash("line")})


# ---------------------------------------------------------------- keys


def _let(value: Column, body) -> Column:
    """*body* of a value that is computed once: a one-element array is transformed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rounded(n: Column) -> Column:
    """*n* with all but its three highest binary digits dropped."""
    # Half is added as no logarithm of a whole number and a half is near a whole one.
    shift = F.greatest(F.lit(0), F.floor(F.log2(n + 0.5)).cast("int") - 2)
    return F.call_function("shiftleft", F.call_function("shiftright", n, shift), shift)


def _length(n: Column, limit: int) -> Column:
    """The length of the segments of a line of *n* units."""
    return F.floor(_rounded(n) / (limit + 1)).cast("int")


def _places(limit: int) -> list[tuple[int, int]]:
    """(segment, offset from its own place) of every key."""
    return [(i, off) for i in range(limit + 1) for off in range(-min(i, limit - i), min(i, limit - i) + 1)]


def _home(n: Column, k: Column, i: int, limit: int) -> Column:
    """Where segment *i* of length *k* stands in a line of *n* characters, from 0."""
    return F.lit(i) * k if 2 * i <= limit else n + F.lit(i - limit - 1) * k


def _with_keys(lines: DataFrame) -> DataFrame:
    """*lines* with ``keys``, those of whole lines; some may be null."""
    n, k, shorter = fresh(lines, "n"), fresh(lines, "k"), fresh(lines, "shorter")
    # In columns of their own, so that they are computed once.  No higher-order functions: those are interpreted.
    sized = lines.withColumn(n, F.length("line"))
    sized = sized.withColumns({k: _length(F.col(n), LIMIT), shorter: _length(F.greatest(F.col(n) - LIMIT, F.lit(LIMIT + 1)), LIMIT)})
    of = lambda k: F.array(*[F.xxhash64(k, F.lit(i), F.substring(F.col("line"), _home(F.col(n), k, i, LIMIT) + (off + 1), k)) for i, off in _places(LIMIT)])
    # From LEAST - LIMIT characters on, no third length lies between the two.
    none = F.array().cast("array<bigint>")
    keys = F.when(F.col(n) < LEAST - LIMIT, none).when(F.col(k) == F.col(shorter), of(F.col(k))).otherwise(F.concat(of(F.col(k)), of(F.col(shorter))))
    return sized.withColumn("keys", keys).drop(n, k, shorter)


#: Columns with the keys of earlier segments, by which a key is known to add nothing to them.
EARLIER = [f"e{j}" for j in range(LIMIT)]


def _level_keys(state: DataFrame) -> DataFrame:
    """*state* (id, chain, text, and more) with a row for each key: key, at and size of the segment, own (whether it
    stands in its own place and has the length of the line's own), and the keys of the line's earlier segments in
    their own places.  Of two lines with a link the shorter shares a segment of its own.

    Where so little is left that a partner may have no segments, the key is of all such rows, with size -1.
    """
    text, n, null = F.col("text"), F.length("text"), F.lit(None).cast("long")
    key = lambda k, i, at: F.xxhash64("chain", k, F.lit(i), F.substring(text, at + 1, k))

    def entry(made: Column, at: Column, size: Column, own: Column, earlier: list[Column]) -> Column:
        return F.struct(made.alias("key"), at.alias("at"), size.alias("size"), own.cast("int").alias("own"), *[e.alias(x) for e, x in zip(earlier, EARLIER, strict=True)])

    def of_length(k: Column) -> Column:
        homes = [_home(n, k, i, LIMIT) for i in range(LIMIT + 1)]
        made = []
        for i, off in _places(LIMIT):
            earlier = [key(k, j, homes[j]) if j < i else null for j in range(LIMIT)]
            made.append(entry(key(k, i, homes[i] + off), homes[i] + off, k, (k == _length(n, LIMIT)) & F.lit(off == 0), earlier))
        return F.array(*made)

    small = F.array(entry(F.xxhash64("chain", F.lit(-1)), F.lit(0), F.lit(-1), F.lit(True), [null] * LIMIT))
    none = F.filter(small, lambda _: F.lit(False))
    lengths = F.array_distinct(F.array(*[_length(F.greatest(n - d, F.lit(LIMIT + 1)), LIMIT) for d in range(LIMIT + 1)]))
    keys = F.concat(F.when(n > LIMIT, F.flatten(F.transform(lengths, of_length))).otherwise(none), F.when(n <= 2 * LIMIT, small).otherwise(none))
    return state.withColumn("made", F.explode(keys)).select(*state.columns, "made.*")


# ---------------------------------------------------------------- verification


def _counts(letters: str) -> Column:
    """Counts of eight symbols, a byte each."""
    count = lambda c: F.least(F.lit(255), F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))).cast("long")
    total = F.lit(0).cast("long")
    for i, c in enumerate(letters):
        total = total.bitwiseOR(F.shiftleft(count(c), 8 * i))
    return total


def _may_be_close() -> Column:
    """Whether the numbers of rows a and b of one key leave room for a link: lengths, counts of symbols."""
    each = [f"abs((shiftrightunsigned(c{j}_a, {8 * i}) & 255) - (shiftrightunsigned(c{j}_b, {8 * i}) & 255))" for j in range(len(LETTERS)) for i in range(8)]
    # The parities of counts first: they cost least and tell most.
    odd = " + ".join(f"bit_count((c{j}_a ^ c{j}_b) & {0x0101010101010101})" for j in range(len(LETTERS)))
    return F.expr(f"abs(n_a - n_b) <= {LIMIT} and greatest(n_a, n_b) >= {LEAST} and {odd} <= {2 * LIMIT} and {' + '.join(each)} <= {2 * LIMIT}")


def _banded(limit: int):
    """Whether two arrays (fields x, y of a struct) are within *limit* edits of their elements.

    For each number of errors e a bit vector tells at which diagonals of the band the text so far can end:
    a step takes equal elements straight on, and an error straight on (substitution), one diagonal down
    (an element of x dropped) or up (one of y added).
    """
    width, bits = 2 * limit + 1, 2 * limit + 2
    full = (1 << width) - 1
    begin = sum((((1 << e + 1) - 1) << limit) << bits * e for e in range(limit + 1))

    def step(c: Column):
        def go(state: Column, i: Column) -> Column:
            same = F.lit(0).cast("long")
            for d in range(-limit, limit + 1):
                same = same.bitwiseOR(F.when(F.get(c.y, i + d) == F.get(c.x, i), F.lit(1 << d + limit).cast("long")).otherwise(F.lit(0).cast("long")))

            def levels(m: Column) -> Column:
                out, below_old, below_new = F.lit(0).cast("long"), None, None
                for e in range(limit + 1):
                    old = F.shiftrightunsigned(state, bits * e).bitwiseAND(F.lit(full))
                    new = old.bitwiseAND(m)
                    if e:
                        new = new.bitwiseOR(below_old).bitwiseOR(F.shiftright(below_old, 1)).bitwiseOR(F.shiftleft(below_new, 1)).bitwiseAND(F.lit(full))
                    out = out.bitwiseOR(F.shiftleft(new, bits * e))
                    below_old, below_new = old, new
                return out

            return F.when(state == 0, state).otherwise(_let(same, levels))

        return go

    def run(c: Column) -> Column:
        many = F.size(c.x)
        steps = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
        last = F.aggregate(steps, F.lit(begin).cast("long"), step(c))
        # The diagonal of both ends, in the vector of *limit* errors.
        goal = F.size(c.y) - many + limit
        return F.when(goal.between(0, width - 1), F.getbit(last, goal + bits * limit) == 1).otherwise(F.lit(False))

    return run


def _both(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def within(a: str, b: str, limit: int) -> Column:
    """Whether columns *a* and *b* are within *limit* edits of their characters; equal blocks at both ends are left out."""
    block = 16
    shared = lambda x, y: F.expr(f"""{block} * (coalesce(nullif(array_position(transform(sequence(0, least(length({x}), length({y})) div {block}),
        i -> substring({x}, i * {block} + 1, {block}) = substring({y}, i * {block} + 1, {block}) and (i + 1) * {block} <= least(length({x}), length({y}))), false), 0), 1) - 1)""")  # noqa: E731
    head = shared(a, b)
    rest_a, rest_b = F.substring(F.col(a), head + 1, F.length(a)), F.substring(F.col(b), head + 1, F.length(b))
    texts = _both(rest_a, rest_b)

    def tail(t: Column) -> Column:
        back = F.struct(F.reverse(t.x).alias("x"), F.reverse(t.y).alias("y"))

        def cut(r: Column) -> Column:
            most = F.least(F.length(r.x), F.length(r.y))
            same = F.transform(F.sequence(F.lit(0), (most / block).cast("int")), lambda i: (F.substring(r.x, i * block + 1, F.lit(block)) == F.substring(r.y, i * block + 1, F.lit(block))) & ((i + 1) * block <= most))
            n = (F.array_position(same, F.lit(False)) - 1).cast("int") * block
            return F.struct(F.substring(t.x, F.lit(1), F.length(t.x) - n).alias("x"), F.substring(t.y, F.lit(1), F.length(t.y) - n).alias("y"))

        return _let(back, cut)

    def distance(t: Column) -> Column:
        chars = lambda x: F.when(F.length(x) == 0, F.array().cast("array<string>")).otherwise(F.split(x, ""))
        return _let(_both(chars(t.x), chars(t.y)), _banded(limit))

    def middle(t: Column) -> Column:
        # What so few edits can replace whole needs no search.
        return F.when(F.greatest(F.length(t.x), F.length(t.y)) <= limit, F.lit(True)).otherwise(distance(t))

    return _let(_let(texts, tail), middle)


# ---------------------------------------------------------------- the join


def _few(rows: DataFrame) -> DataFrame:
    """*rows*, to be broadcast if their number is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _settled(rows: DataFrame, collided: DataFrame | None) -> DataFrame:
    """*rows* (id, check) in which ids that different lines share are told apart by the second hash."""
    if collided is None:
        return rows
    told = rows.join(_few(collided), rows["id"] == collided["shared_id"], "left")
    return told.withColumn("id", F.when(F.col("shared_id").isNotNull(), F.xxhash64("id", "check")).otherwise(F.col("id"))).drop("shared_id")


def _indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, classes, collided): doc_id, row, line_no, id, check, keys of every line that is not blank; id and first
    (no_id, doc_id, row, line_no) of each different line; the ids that several lines share, if any do."""
    rows = stored(_with_keys(split_lines(docs)).drop("line"), "line-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "line_no")).alias("first")
    count = lambda of: stored(of.groupBy("id").agg(first, F.min("check").alias("low"), F.max("check").alias("high")), "line-classes")
    classes, collided = count(rows), None
    shared = classes.where("low <> high").select(F.col("id").alias("shared_id"))
    if not shared.isEmpty():
        collided = stored(shared, "line-collisions")
        rows = _settled(rows, collided)
        classes = count(rows)
    return rows, classes.select("id", "first"), collided


def _candidates(docs: DataFrame, rows: DataFrame, collided: DataFrame | None) -> DataFrame:
    """id, line and the numbers of the different lines that share a key with another."""
    keys = rows.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select(F.col("key").alias("shared_key"))
    shared = stored(shared, "line-keys")
    ids = keys.join(_few(shared), F.col("key") == F.col("shared_key"), "left_semi").select(F.col("id").alias("of")).distinct()
    ids = stored(ids, "line-ids")
    found = _settled(split_lines(docs).select("id", "check", "line"), collided)
    texts = found.join(_few(ids), F.col("id") == F.col("of"), "left_semi").groupBy("id").agg(F.first("line").alias("line"))
    more = {"n": F.length("line")} | {f"c{j}": _counts(x) for j, x in enumerate(LETTERS)}
    lines = stored(texts.withColumns(more), "line-numbers")
    discard(shared, ids)
    return lines


NUMBERS = ["n", *(f"c{j}" for j in range(len(LETTERS)))]


def _pairs(lines: DataFrame) -> DataFrame:
    """a, b: ids of the lines that share keys and that numbers leave room for."""
    state = lines.where(F.col("n") >= LEAST - LIMIT).select("id", F.lit(0).cast("long").alias("chain"), F.col("line").alias("text"), *NUMBERS)
    done, before = None, None
    while True:
        keys = _level_keys(state).drop("text")
        bounds = [f(e).alias(f"{name}_{e}") for e in EARLIER for name, f in (("low", F.min), ("high", F.max))]
        sums = keys.groupBy(F.col("key").alias("of")).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("many"), F.max("own").alias("owned"), F.max("size").alias("cut"), *bounds)
        # Where all lines of a crowded key share the key of an earlier segment, that key has all their pairs.
        covered = F.coalesce(F.greatest(*[(F.col(f"low_{e}") == F.col(f"high_{e}")).cast("int") for e in EARLIER]), F.lit(0)) == 1
        kind = F.when((F.col("many") <= DENSE) | (F.col("cut") < 0), F.lit("compare")).when(~covered, F.lit("divide"))
        sums = stored(sums.where("low <> high and owned = 1").select("of", kind.alias("kind")).where("kind is not null"), "line-sums")
        members = stored(keys.drop(*EARLIER).join(_few(sums), F.col("key") == F.col("of")).drop("of"), "line-members")
        rows = members.where("kind = 'compare'").groupBy("key", "id", *NUMBERS).agg(F.max("own").alias("own"))
        left, right = (rows.select(*[F.col(c).alias(f"{c}_{x}") for c in rows.columns]) for x in "ab")
        found = left.join(right, (F.col("key_a") == F.col("key_b")) & (F.col("id_a") < F.col("id_b")) & (F.col("own_a") + F.col("own_b") > 0) & _may_be_close())
        found = stored(found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "line-pairs")
        done = found if done is None else done.union(found)
        crowded = members.where("kind = 'divide'").select(F.col("id").alias("of_id"), F.col("chain").alias("of_chain"), "key", "at", "size").distinct()
        if crowded.isEmpty():
            discard(sums, members, *([] if before is None else [before]))
            return done.distinct()
        rest = state.join(crowded, (F.col("id") == F.col("of_id")) & (F.col("chain") == F.col("of_chain")))
        # The lines without the segment that they share.
        text = F.concat(F.substring(F.col("text"), F.lit(1), F.col("at")), F.substring(F.col("text"), F.col("at") + F.col("size") + 1, F.length("text")))
        state = stored(rest.select("id", F.col("key").alias("chain"), text.alias("text"), *NUMBERS).distinct(), "line-rest")
        discard(sums, members, *([] if before is None else [before]))
        before = state


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): doc_id, row, line_no, id of every line; id and first of each different one; a, b of
    each link between ids, a < b."""
    rows, classes, collided = _indexed(docs)
    lines = _candidates(docs, rows, collided)
    pairs = _pairs(lines)
    x, y = (lines.select(F.col("id").alias(f"i{c}"), F.col("line").alias(c)) for c in "xy")
    both = pairs.join(x, F.col("a") == F.col("ix")).join(y, F.col("b") == F.col("iy"))
    return rows, classes, stored(both.where(within("x", "y", LIMIT)).select("a", "b"), "line-links")


def _told(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, told): of every line; of every different one line_id, class_id, links, stays (where its class's first line is)."""
    rows, classes, found = links(docs)
    roots = components(found)
    both = found.select(F.col("a").alias("of"), "b").union(found.select(F.col("b").alias("of"), "a"))
    degree = both.groupBy("of").agg(F.count(F.lit(1)).alias("links"))
    rooted = classes.join(roots.select(F.col("id").alias("r"), "root"), F.col("id") == F.col("r"), "left").select("id", "first", F.coalesce("root", "id").alias("class_id"))
    firsts = rooted.groupBy(F.col("class_id").alias("c")).agg(F.min("first").alias("stays"))
    told = rooted.join(firsts, F.col("class_id") == F.col("c")).join(degree, F.col("id") == F.col("of"), "left")
    return rows, stored(told.select(F.col("id").alias("line_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "stays"), "line-told")


def _placed(docs: DataFrame) -> DataFrame:
    rows, told = _told(docs)
    # Both sides are plain exchanges: a line that very many documents share is split.
    joined = rows.select("doc_id", "row", "line_no", "id").join(told, F.col("id") == F.col("line_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("row") == F.col("stays.row")) & (F.col("line_no") == F.col("stays.line_no"))
    return joined.select("doc_id", "row", "line_no", "line_id", "class_id", "links", stays.alias("stays"))


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line_id, class_id, links, stays: one row for each line that is not blank.

    line_id stands for the line's normalised text, class_id is the least line_id that links reach; links counts the
    different lines linked to it; stays is true for the first line of its class, by doc_id (null last), then line
    number.  Lines whose longer one has fewer than ``LEAST`` characters are equal or not.  Blank lines and null texts
    have no row.  Rows that are equal in doc_id and text are one document: their lines stay or go together.  Texts and
    lines of any length are compared whole.  Other columns, whatever their names, are not read; no rows give no rows.
    """
    return _placed(docs.select("doc_id", "text")).drop("row")


def dedup(docs: DataFrame) -> DataFrame:
    """*docs* with the lines of ``text`` that repeat an earlier line of any document removed.

    Blank lines stay; a text that loses all its lines becomes empty, a null text stays null.  All other columns,
    whatever their names, and all rows stay; an empty table stays empty.
    """
    row, of, gone, lines = (fresh(docs, x) for x in ("row", "of", "gone", "lines"))
    out = _placed(docs.select("doc_id", "text")).where("not stays")
    # Its size is bounded by the lines of one document.
    lost = stored(out.groupBy(F.col("row").alias(of), F.col("doc_id").alias(f"{of}_id")).agg(F.collect_set("line_no").alias(gone)), "line-gone")
    few = lost.agg(F.coalesce(F.sum(F.size(gone) + 2), F.lit(0))).first()[0] <= BROADCAST_ROWS
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    joined = keyed.join(F.broadcast(lost) if few else lost, (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(f"{of}_id")), "left")
    kept = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda i: F.get(x, i)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), kept))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op4_lines(spark, sf_dir: str) -> DataFrame:
    """Every line with its class, its number of links and whether it stays."""
    return memberships(table(spark, sf_dir, "documents"))
