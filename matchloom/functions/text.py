"""Column functions on names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Small Latin letters that decompose (NFKD) into a letter and marks, and those letters.
_LATIN = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for block in ((0xDF, 0x250), (0x1E00, 0x1F00)) for c in range(*block) if chr(c).islower() and unicodedata.combining(unicodedata.normalize("NFKD", chr(c))[-1])}
MARKED, PLAIN = "".join(_LATIN), "".join(_LATIN.values())


def normalise(c: Column) -> Column:
    """Lower case, marks off, hyphens to spaces, no space around."""
    return F.trim(F.replace(F.translate(F.lower(c), MARKED, PLAIN), F.lit("-"), F.lit(" ")))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def token_similarity(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(share of a's tokens that b has, token distance, edits between both).

    A token is had at no cost if it starts one of b's or the other way round, and at a cost of 1 if one is an edit away; the
    distance adds the least cost of each token that is had.
    """
    ta, tb = tokens(a), tokens(b)
    cost = lambda t, u: F.when(t.startswith(u) | u.startswith(t), 0).when(F.levenshtein(t, u, 1) == 1, 1)
    costs = F.filter(F.transform(ta, lambda t: F.array_min(F.transform(tb, lambda u: cost(t, u)))), lambda x: x.isNotNull())
    share = F.coalesce(F.try_divide(F.size(costs), F.size(ta)), F.lit(0.0))
    return share, F.aggregate(costs, F.lit(0), lambda x, y: x + y), F.levenshtein(a, b)
