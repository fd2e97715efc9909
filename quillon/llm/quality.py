"""Quality rules: a table of thresholds compiled into one projection, with no user function.

Words are runs of characters other than space and U+0009 to U+000D. A null text has no words and fails the base rule. A ratio
whose denominator is zero counts as zero. Repeated rows get the same verdict each; other columns are not read; an empty table
gives an empty result. The cost of a text is linear in its words but for one sort of its 3-word windows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages expected.
STOP_WORDS = (
    "the of and to in is that it for was on are as with his they at be this have from or by one had not but what all were we when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could my than first been call who its now find long down day did get come made may part a "
    "der die das und ist nicht ein eine zu mit von auf den dem im für sich auch es an werden aus er sie nach bei um am sind noch wie "
    "le la les de des du et un une est que qui dans pour pas sur au par avec ce il en ne se plus son "
    "el los las y del se por con una su para al lo como más pero sus o este sí"
).split()


class Rule(NamedTuple):
    """A document is kept if, for every rule, ``low <= feature <= high`` (null: no bound on that side)."""

    feature: str
    low: float | None
    high: float | None


#: Share of words, but for words: characters a word; dup_lines, bullets and ellipses: share of lines with a word.
RULES = (
    Rule("word_length", 2.0, 14.0),
    Rule("symbols", None, 0.1),
    Rule("stop_words", 0.06, None),
    Rule("dup_lines", None, 0.5),
    Rule("bullets", None, 0.9),
    Rule("ellipses", None, 0.3),
)
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "stop_words": ("n_stop_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "bullets": ("n_bullet_lines", "n_lines"),
    "ellipses": ("n_ellipsis_lines", "n_lines"),
}


def features(text: str = "text") -> Column:
    """A struct of the counts of a text column. ``transform(array(x), v -> ...)[0]`` names a value so that it is computed once."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    windows = "transform(sequence(0, size(ws) - 3), i -> named_struct('h', xxhash64(ws[i], ws[i + 1], ws[i + 2]), 'i', i))"
    repeated = "filter(s, (x, j) -> get(s, j - 1).h <=> x.h or get(s, j + 1).h <=> x.h)"
    covered = f"size(array_distinct(flatten(transform({repeated}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    return F.expr(rf"""
        transform(array(coalesce(`{text}`, '')), t ->
          transform(array(named_struct(
              'ws', filter(split(t, '{SPACE}+'), w -> w <> ''),
              'ls', filter(split(t, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]'))), p ->
            named_struct(
              'n_words', cast(size(p.ws) as bigint),
              'word_chars', cast(length(regexp_replace(t, '{SPACE}+', '')) as bigint),
              'n_symbols', cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint),
              'n_lines', cast(size(p.ls) as bigint),
              'n_dup_lines', cast(size(p.ls) - size(array_distinct(p.ls)) as bigint),
              'n_bullet_lines', cast(size(filter(p.ls, l -> l rlike '^{SPACE}*[-*•]')) as bigint),
              'n_ellipsis_lines', cast(size(filter(p.ls, l -> l rlike '(…|[.][.][.]){SPACE}*$')) as bigint),
              'n_stop_words', cast(size(filter(p.ws, w -> lower(w) in ({stops}))) as bigint),
              'n_repeat_words', cast(transform(array(p.ws), ws -> if(size(ws) < 3, 0,
                  transform(array(sort_array({windows})), s -> {covered})[0]))[0] as bigint)))[0])[0]""")


def compiled(f: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over a struct of counts."""
    verdict = F.lit(True)
    for rule in rules:
        top, bottom = (f.getField(x) for x in RATIOS[rule.feature])
        ratio = F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))
        if rule.low is not None:
            verdict = verdict & (ratio >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (ratio <= F.lit(rule.high))
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed and kept. Base: too few words, or too many of them in repeated 3-word windows."""
    f = F.col("_lm_f")
    base = (f.n_words < min_words) | (100 * f.n_repeat_words > max_repeat_percent * f.n_words)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines"]
    return docs.select("doc_id", features().alias("_lm_f")).select("doc_id", *[f.getField(c).alias(c) for c in counts], base.alias("base_failed"), (~base & compiled(f, rules)).alias("kept"))


def oracle(rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> str:
    """The same in DuckDB SQL over the view documents."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    space = r"[\x20\x09-\x0D]"
    tests = []
    for rule in rules:
        top, bottom = RATIOS[rule.feature]
        ratio = f"(case when {bottom} > 0 then {top} / {bottom} else 0.0 end)"
        tests += [f"{ratio} >= {rule.low}"] * (rule.low is not None) + [f"{ratio} <= {rule.high}"] * (rule.high is not None)
    return rf"""
      with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
      p as (select *, list_filter(string_split_regex(t, '{space}+'), lambda w: w <> '') as ws,
                   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from d),
      win as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k
              from (select r, ws, unnest(range(1, len(ws) - 1)) as i from p where len(ws) >= 3)),
      dup as (select r, i from (select r, i, count(*) over (partition by r, k) as c from win) where c > 1),
      cov as (select r, count(distinct i + o) as n from dup, (values (0), (1), (2)) as x(o) group by r),
      f as (select doc_id, cast(len(ws) as bigint) as n_words,
              cast(length(regexp_replace(t, '{space}+', '', 'g')) as bigint) as word_chars,
              cast(length(t) - length(translate(t, '{SYMBOLS}', '')) as bigint) as n_symbols,
              cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
              cast(coalesce(cov.n, 0) as bigint) as n_repeat_words,
              cast(len(ls) as bigint) as n_lines,
              cast(len(list_filter(ws, lambda w: lower(w) in ({stops}))) as bigint) as n_stop_words,
              cast(len(list_filter(ls, lambda l: regexp_matches(l, '^{space}*[-*•]'))) as bigint) as n_bullet_lines,
              cast(len(list_filter(ls, lambda l: regexp_matches(l, '(…|[.][.][.]){space}*$'))) as bigint) as n_ellipsis_lines
            from p left join cov using (r)),
      b as (select *, n_words < {min_words} or 100 * n_repeat_words > {max_repeat_percent} * n_words as base_failed from f)
      select *, not base_failed and {' and '.join(tests)} as kept from b"""
