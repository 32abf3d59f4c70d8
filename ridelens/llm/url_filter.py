"""URL filter: host and path rules first, then a weighted vocabulary found with one Aho-Corasick pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table

_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Vocabulary:
    """One strict term rejects a URL, and so do `least_soft` distinct soft terms.

    A term counts only between boundaries: no ASCII letter or digit right before or after it.
    """

    strict: tuple[str, ...] = ("porn", "porno", "xxx", "hentai", "camgirls", "casino", "viagra", "warez", "keygen", "phishing", "malware", "escorts")
    soft: tuple[str, ...] = ("adult", "sex", "nude", "bet", "betting", "poker", "slots", "loan", "pills", "torrent", "crack", "hack", "spam", "clickbait", "replica", "dating")
    least_soft: int = 2


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the URL's path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = (), vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """`id_col`, host, path, rule, verdict, strict_hits, soft_terms of every row.

    Of the rules that fit, the longest (host and path together) decides, a block before an allow of equal
    text; without one the vocabulary does. A null URL counts as empty: no host, no rule, allowed. Only the
    id and the URL are read. Rules and vocabulary are parameters of the driver, so they are small.
    """
    struct, arrow = schema_of("__id long, host string, path string, rule string, verdict string, strict_hits long, soft_terms long")
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    terms = {t: False for t in vocabulary.soft} | {t: True for t in vocabulary.strict}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for term, strict in terms.items():
            finder.add_word(term, (term, strict))
        if terms:
            finder.make_automaton()
        for batch in batches:
            out = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                url = url or ""
                host, path = split_url(url)
                strict, soft = 0, set()
                low = url.translate(_LOWER)
                for end, (term, hard) in finder.iter(low) if terms else ():
                    start = end - len(term)  # the place before the term
                    if (start < 0 or low[start] not in _ALNUM) and (end + 1 == len(low) or low[end + 1] not in _ALNUM):
                        if hard:
                            strict += 1
                        else:
                            soft.add(term)
                rule = next((r for r in ranked if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), None)
                bad = strict > 0 or len(soft) >= vocabulary.least_soft
                out.append((page, host, path, rule.name if rule else None, rule.verdict if rule else "block" if bad else "allow", strict, len(soft)))
            yield pack(arrow, list(zip(*out)) if out else [[]] * len(arrow))

    return pages.select(F.col(id_col).cast("long"), F.col(url_col)).mapInArrow(judge, struct).withColumnRenamed("__id", id_col)


RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def _sql(rules: Sequence[Rule], vocabulary: Vocabulary) -> str:
    found = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    ranked = sorted(rules, key=lambda r: -len(r.name))
    rule = " ".join(f"when {fits(r)} then '{r.name}'" for r in ranked)
    verdict = " ".join(f"when '{r.name}' then '{r.verdict}'" for r in rules)
    strict = " or ".join(map(found, vocabulary.strict))
    soft = " + ".join(f"{found(t)}::bigint" for t in vocabulary.soft)
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    with u as (select page_id, coalesce(url, '') as url, {low.format("coalesce(url, '')")} as low,
                      case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    h as (select page_id, low, {low.format("regexp_extract(rest, '^[^/?#]*')")} as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
    r as (select *, case {rule} end as rule from h)
    select page_id, host, path, rule,
           case rule {verdict} else case when {strict} or {soft} >= {vocabulary.least_soft} then 'block' else 'allow' end end as verdict from r
    """


@register("op10_url_filter", _sql(RULES, Vocabulary()))
def op10_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), rules=RULES).select("page_id", "host", "path", "rule", "verdict")
