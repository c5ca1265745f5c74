"""Alternates for a whole shelf: a set-similarity join of titles in place of a comparison of every book with every candidate.

Titles are compared once, however many books have them.  Every title's letters are ordered from the rarest on (letters are counted over all
titles; there are no more than Unicode has, which bounds the table that is broadcast).  Two titles whose letters have a Jaccard
similarity of t share one of the first n - ceil(t n) + 1 of each, and their numbers of letters differ by no more than that factor; a
title that lies inside another has its rarest letter there.  Pairs that meet neither way are never made; those that do are
scored in full.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.sources.shared import settled

#: Shares of name and author in a book's score, fixed values.
NAME_SHARE, AUTHOR_SHARE = 0.65, 0.35
#: Levels of similarity, and places in a source, that a number of 62 bits tells apart: two shares of under 46,000 letters differ by more than a level.
_LEVELS = 1 << 31


def _letters(said: Column) -> Column:
    return F.array_distinct(F.filter(F.split(said, ""), lambda c: F.trim(c) != ""))


def _forms(titles: DataFrame) -> DataFrame:
    """(title, normal, form, letters) of (title, normal): the letters of titles as they are and of normalised ones."""
    each = F.array(F.struct(F.lit("as is").alias("form"), _letters(F.col("title")).alias("letters")), F.struct(F.lit("normal").alias("form"), _letters(F.col("normal")).alias("letters")))
    return titles.select("title", "normal", F.inline(each))


class _Sets:
    """Sets of letters as columns: the bits of a number where all titles have no more than BITS different letters, else arrays."""

    BITS = 62

    def __init__(self, counts: DataFrame):
        self.small = counts.count() <= self.BITS
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.row_number().over(Window.orderBy("count", "letter")) - 1)) if self.small else F.lit(0).cast("long")
        self.counts = counts.withColumn("bit", bit)

    def of(self, letters: Column) -> Column:
        """The set of an array of different (count, letter, bit)."""
        return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: s + x["bit"]) if self.small else F.transform(letters, lambda x: x["letter"])

    def shared(self, a: str, b: str) -> Column:
        """How many letters both sets have."""
        return F.bit_count(F.col(a).bitwiseAND(F.col(b))) if self.small else F.size(F.array_intersect(a, b))

    def meet(self, a: str, b: str) -> Column:
        return F.col(a).bitwiseAND(F.col(b)) != 0 if self.small else F.arrays_overlap(a, b)


def _tokens(titles: DataFrame, sets: _Sets, least: float) -> DataFrame:
    """(title, normal, held, m, first, form, letter, before, rarest, early, n) per letter of a title as it is and normalised.

    held are the normalised title's m letters, first those of them that a similar title must share one of, before those in front of this letter;
    n is the number of a form's letters.
    """
    rows = _forms(titles).select("title", "normal", "form", F.explode("letters").alias("letter")).join(F.broadcast(sets.counts), "letter")
    in_order = lambda form: F.array_sort(F.collect_list(F.when(F.col("form") == form, F.struct("count", "letter", "bit"))))
    both = rows.groupBy("title", "normal").agg(in_order("normal").alias("held"), in_order("as is").alias("whole"))
    m = F.size("held")
    n_first = F.greatest(m - F.ceil(m * F.lit(least) - 1e-9).cast("int") + 1, F.lit(0))
    each = F.array(F.struct(F.lit("normal").alias("form"), F.col("held").alias("l")), F.struct(F.lit("as is").alias("form"), F.col("whole").alias("l")))
    forms = both.select("title", "normal", sets.of(F.col("held")).alias("held"), m.alias("m"), n_first.alias("n_first"), sets.of(F.slice("held", F.lit(1), n_first)).alias("first"), F.inline(each))
    placed = forms.select("*", F.size("l").alias("n"), F.posexplode("l").alias("at", "x"))
    early = (F.col("form") == "normal") & (F.col("at") < F.col("n_first"))
    return placed.select("title", "normal", "held", "m", "first", "form", F.col("x.letter").alias("letter"), sets.of(F.slice("l", F.lit(1), F.col("at"))).alias("before"), (F.col("at") == 0).alias("rarest"), early.alias("early"), "n")


def title_pairs(titles: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """(title, other, alike) of the titles and others, each given once, trimmed and in small letters, that are alike by at least ``least`` (above 0).

    Of the letters by which a pair could be found, the first one finds it; only pairs that are not found so may be found by their rarest letters.
    """
    a = settled(titles.select("title", text.normal_title(F.col("title")).alias("normal")))
    b = settled(others.select(F.col("other").alias("title"), text.normal_title(F.col("other")).alias("normal")))
    sets = _Sets(settled(_forms(a.union(b)).select(F.explode("letters").alias("letter")).groupBy("letter").count()))
    x, y = settled(_tokens(a, sets, least)), settled(_tokens(b, sets, least))
    n, m = F.col("x.m"), F.col("y.m")
    sizes = (m >= F.lit(least) * n - 1e-9) & (n >= F.lit(least) * m - 1e-9)
    same = (F.col("x.form") == F.col("y.form")) & (F.col("x.letter") == F.col("y.letter"))
    by_first = x.where("early").alias("x").join(y.where("early").alias("y"), same & sizes & ~sets.meet("x.before", "y.before"))
    missed = same & ~(sizes & sets.meet("x.first", "y.first"))
    holds = x.alias("x").join(y.where("rarest").alias("y"), missed & (F.col("y.n") <= F.col("x.n")))
    lies_in = x.where("rarest").alias("x").join(y.alias("y"), missed & (F.col("x.n") <= F.col("y.n")))
    both = sets.shared("x.held", "y.held")
    score = text.text_similarity_of(F.col("x.title"), F.col("x.normal"), F.col("y.title"), F.col("y.normal"), both / (n + m - both))
    # as a list of one that is filtered and unfolded, a pair's score is worked out once
    kept = F.filter(F.array(F.struct(score.alias("alike"))), lambda s: s["alike"] >= least)
    scored = [met.select("x.title", F.col("y.title").alias("other"), F.inline(kept)) for met in (by_first, holds, lies_in)]
    return scored[0].unionByName(scored[1].unionByName(scored[2]).distinct())


def _plain(c: str) -> Column:
    return F.trim(F.lower(F.coalesce(c, F.lit(""))))


def shelf_alternates(shelf: DataFrame, candidates: DataFrame, book: str = "book_id", least: float = 0.45) -> DataFrame:
    """(book, source_id, pos, name, author, score): for each book of a shelf the best candidate of each other source.

    shelf: book, name, author, source_id; candidates: source_id, pos, name, author.  The score is that of alternates(): the highest
    counts, then the first place, and those below ``least`` go.  Null names and authors are empty; an empty name is like none.
    """
    has_author = not shelf.where(_plain("author") != "").isEmpty()
    least_name = max((least - AUTHOR_SHARE) / NAME_SHARE, 0.01) if has_author else least
    asked = shelf.select(book, F.col("source_id").alias("own"), _plain("name").alias("title"), _plain("author").alias("by"))
    # a source's first of those that differ in nothing but their place
    held = candidates.withColumns({"other": _plain("name"), "other_by": _plain("author")}).where("other <> ''").groupBy("source_id", "other", "other_by").agg(F.min_by(F.struct("pos", "name", "author"), "pos").alias("c"))
    # a source's candidates are numbered by their place, so that similarity and place make one number, the least of which is the best
    in_source = Window.partitionBy("source_id").orderBy("c.pos", "other", "other_by")
    held = settled(held.withColumn("place", F.row_number().over(in_source).cast("long")))
    pairs = settled(title_pairs(asked.where("title <> ''").select("title").distinct(), held.select("other").distinct(), least_name))
    # what the author adds is the same for all candidates of one author: of a source's candidates by one author the title's best is enough
    key = F.floor((1 - F.col("alike")) * _LEVELS) * _LEVELS + F.col("place")
    first = pairs.join(held.select("other", "source_id", "other_by", "place"), "other").groupBy("title", "source_id", "other_by").agg(F.min(key).alias("key"))
    found = first.select("title", "source_id", (F.col("key") % _LEVELS).alias("place")).join(held, ["source_id", "place"]).join(pairs, ["title", "other"])
    known = asked.select("title", "by").distinct().withColumn("normal_by", text.normal_title(F.col("by")))
    others = found.select("title", "source_id", "c", "alike", "other_by", text.normal_title(F.col("other_by")).alias("other_normal"))
    authors = text.text_similarity_of(F.col("by"), F.col("normal_by"), F.col("other_by"), F.col("other_normal"))
    score = F.when(F.col("by") == "", F.col("alike")).otherwise(F.col("alike") * NAME_SHARE + authors * AUTHOR_SHARE)
    # as a list of one that is filtered and unfolded, a score is worked out once
    kept = F.filter(F.array(F.struct(score.alias("score"))), lambda s: s["score"] >= least)
    scored = known.join(others, "title").select("title", "by", "source_id", "c", F.inline(kept))
    best = scored.groupBy("title", "by", "source_id").agg(F.max_by(F.struct("c.*", "score"), F.struct("score", -F.col("c.pos"))).alias("r"))
    return asked.join(best, ["title", "by"]).where(F.col("source_id") != F.col("own")).select(book, "source_id", "r.*")
