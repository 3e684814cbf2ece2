"""URL filter: host and path rules, then a weighted vocabulary found by an Aho-Corasick automaton.

The longest rule that fits decides. A url without a rule is blocked if it holds one strict term, or at
least ``soft_hits`` distinct soft terms, each between boundaries: no ASCII letter or digit before or after it.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; the vocabulary
still judges what text it has (null: allowed); a null page_id and repeated rows are judged like others;
an empty table gives an empty table; other columns, html too, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.common import map_rows, table, taken

#: (verdict, host and path); a rule fits its host, all subdomains, and paths that start with its path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
STRICT = ("porn", "xxx", "casino", "viagra", "cialis", "escort", "hentai", "malware", "warez", "keygen", "cheap-pills", "ads-track")
SOFT = ("adult", "sex", "nude", "bet", "betting", "poker", "slots", "pills", "pharmacy", "cheap", "free", "download", "torrent", "crack", "track", "tracker", "ads", "ad", "popup", "click", "loan", "payday", "win", "bonus", "dating")

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    stop = min((k for c in "?#" if (k := rest.find(c, end)) >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:stop]


class Rules:
    """Rules by host name, and by path below it: a url is looked up by its host's suffixes, however many rules there are."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.paths: dict[str, dict[str, tuple[str, str]]] = {}
        for verdict, rule in rules:
            name, slash, rest = rule.partition("/")
            known = self.paths.setdefault(name, {})
            known[slash + rest] = min(known.get(slash + rest, (verdict, rule)), (verdict, rule))
        self.lengths = {name: sorted({len(p) for p in paths}, reverse=True) for name, paths in self.paths.items()}

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits; of equally long ones the first in code-point order."""
        fits, at = [], 0
        while True:
            name = host[at:]
            for n in self.lengths.get(name, ()):
                found = self.paths[name].get(path[:n]) if n <= len(path) else None
                if found:
                    fits.append((-len(found[1]), found[1], found[0]))
                    break
            at = host.find(".", at) + 1
            if not at:
                return min(fits)[:0:-1] if fits else None


@lru_cache(maxsize=4)
def _indexed(rules: tuple[tuple[str, str], ...]) -> Rules:
    return Rules(rules)


def rule_of(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    return _indexed(tuple(rules)).best(host, path)


def listed(spark: SparkSession, path: str, columns: tuple[str, ...], most: int = 1_000_000) -> tuple:
    """The rows of a Parquet table of rules (verdict, rule) or of a text file of terms (value), which every worker holds;
    ValueError for more than ``most``."""
    reader = spark.read.text(path) if columns == ("value",) else spark.read.parquet(path)
    rows = reader.select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in {path}")
    return tuple(r[0].strip() for r in rows if r[0] and r[0].strip()) if len(columns) == 1 else tuple(tuple(r) for r in rows)


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (weight, term))
    found.make_automaton()
    return found


def _wordly(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z"


def hits(url: str | None, strict=STRICT, soft=SOFT) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms between boundaries, sorted."""
    text = (url or "").translate(_LOWER)
    found = {1: set(), 2: set()}
    for end, (weight, term) in automaton(strict, soft).iter(text):
        start = end - len(term) + 1
        if not (start and _wordly(text[start - 1]) or end + 1 < len(text) and _wordly(text[end + 1])):
            found[weight].add(term)
    return sorted(found[2]), sorted(found[1])


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: int = 2) -> DataFrame:
    """(page_id, host, path, rule, verdict, strict_terms, soft_terms). Rules and terms may be lists of any length, as
    listed() reads them."""
    rules, strict, soft = tuple(rules), tuple(strict), tuple(soft)
    names = ("page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms")

    def run(rows):
        out = {n: [] for n in names}
        for page, url in zip(rows["page_id"], rows["url"]):
            host, path = host_and_path(url)
            rule = rule_of(host, path, rules) if host else None
            bad, doubtful = hits(url, strict, soft)
            verdict = rule[0] if rule else "block" if bad or len(doubtful) >= soft_hits else "allow"
            for n, v in zip(names, (page, host, path, rule[1] if rule else None, verdict, bad, doubtful)):
                out[n].append(v)
        return out

    schema = "page_id long, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>"
    return map_rows(taken(pages, "page_id", "url"), run, schema, size=4096, char_col="url")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _terms_sql(terms) -> str:
    return " + ".join(f"cast(regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') as int)" for t in terms)


_RULES_SQL = "\n".join(
    f"  union all select page_id, host, path, '{rule}', '{verdict}' from p where (host = '{rule.partition('/')[0]}' or ends_with(host, '.{rule.partition('/')[0]}')) and starts_with(path, '/{rule.partition('/')[2]}')"
    for verdict, rule in RULES
)

ORACLE_SQL = f"""
with p as (
  select page_id, coalesce(url, '') url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') u,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) path
  from pages),
f as (
  select page_id, host, path, null rule, null verdict from p where false
{_RULES_SQL}),
best as (select page_id, host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) verdict from f group by page_id, host, path)
select p.page_id, p.host, p.path, best.rule,
       coalesce(best.verdict, case when {_terms_sql(STRICT)} >= 1 or {_terms_sql(SOFT)} >= 2 then 'block' else 'allow' end) verdict
from p left join best on p.page_id = best.page_id
"""
