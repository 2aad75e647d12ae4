"""Guards against matches that say nothing: shared beginnings, boilerplate, headings. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# fixed values: shortest common beginning, closeness of rivals, delimiters that end a heading
LEAST_PREFIX, NEAR_TIE = 2, 0.03
DELIMITERS = r"[\s:：|/／・、。,，;；()（）\-－_]"


def common_prefix(a: str, b: str) -> Column:
    """Length of the common beginning of two columns."""
    return F.expr(f"coalesce(array_min(filter(sequence(1, greatest(least(length({a}), length({b})), 1)), i_ -> substring({a}, i_, 1) <> substring({b}, i_, 1))) - 1, least(length({a}), length({b})))")


def shares_no_gram(a: Column, b: Column) -> Column:
    return ~F.arrays_overlap(T.grams(a), T.grams(b))


def prefix_dominates(a: str, b: str) -> Column:
    """Whether two texts are alike by their beginning only: what follows it shares no bigram."""
    n = common_prefix(a, b)
    rest = lambda c: F.substring(F.col(c), n + 1, F.length(c))
    return F.coalesce((n >= LEAST_PREFIX) & shares_no_gram(rest(a), rest(b)), F.lit(False))


def without(text: str, segments: str) -> Column:
    """``text`` without any of the array column ``segments``; longer ones go first."""
    longest = f"array_sort(filter({segments}, s_ -> s_ is not null and s_ <> ''), (p_, q_) -> case when length(p_) <> length(q_) then length(q_) - length(p_) when p_ < q_ then -1 when p_ > q_ then 1 else 0 end)"
    return F.expr(f"aggregate({longest}, {text}, (t_, s_) -> replace(t_, s_, ''))")


def boilerplate_dominates(a: str, b: str, segments: str) -> Column:
    """Whether two texts are alike by boilerplate only: without these segments they share no bigram."""
    rest_a, rest_b = without(a, segments), without(b, segments)
    some = F.exists(F.col(segments), lambda s: F.contains(F.col(a), s) & F.contains(F.col(b), s))
    return F.coalesce(some & shares_no_gram(rest_a, rest_b), F.lit(False))


def only_in_heading(keyword: str, target: str, heading: str) -> Column:
    """Whether a keyword occurs in a target only inside the heading that both rows share, which a delimiter ends."""
    rest = F.expr(f"case when startswith({target}, {heading}) then substring({target}, length({heading}) + 1) else {target} end")
    ends = F.rlike(F.substring(rest, 1, 1), F.lit(DELIMITERS)) | (F.length(rest) == 0)
    shared = F.expr(f"length({heading}) > 0 and startswith({target}, {heading}) and contains({heading}, {keyword})")
    return F.coalesce(shared & ends & ~F.contains(rest, F.col(keyword)), F.lit(False))


def code_hit_is_boilerplate(tokens_a: str, tokens_b: str, boilerplate: str) -> Column:
    """Whether every token that makes a code hit (the shorter of two, one inside the other) is boilerplate.

    Without a hit it is false.
    """
    hits = f"filter(flatten(transform({tokens_a}, x_ -> transform({tokens_b}, y_ -> case when contains(y_, x_) then x_ when contains(x_, y_) then y_ end))), t_ -> t_ is not null)"
    return F.coalesce(F.expr(f"size({hits}) > 0 and forall({hits}, t_ -> array_contains({boilerplate}, t_))"), F.lit(False))


def keywords(entry: str, most: int = 20, least_length: int = 2) -> Column:
    """Keywords of a field's entry: itself and its codes always, then segments and words up to ``most`` in all."""
    codes = f"regexp_extract_all({entry}, '([A-Za-z]+[-_]?[0-9][A-Za-z0-9_-]*)', 1)"
    parts = f"concat(split({entry}, '[、。,，;；/／|]'), split({entry}, '[^\\\\p{{L}}\\\\p{{N}}_-]+'))"
    clean = lambda array: f"filter(transform({array}, s_ -> trim(s_)), s_ -> length(s_) >= {least_length})"
    must = f"array_distinct({clean(f'concat(array({entry}), {codes})')})"
    return F.expr(f"array_union({must}, slice(array_except({clean(parts)}, {must}), 1, greatest({most} - size({must}), 0)))")
