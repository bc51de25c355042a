"""URL filter: pattern rules indexed by their rarest literal token, in DataFrame functions only.

Host rules decide first: of those whose host is the URL's or a parent of it and whose
path begins the URL's, the longest. All other URLs go to pattern rules. A rule's
literal tokens must stand in any URL that its regular expression matches; the rule is
filed under the one that the fewest URLs hold. A URL's tokens fetch the rules filed
under them, and only those run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """`tokens`: lower-case runs of letters or digits, whole tokens in every URL (lower case) that `pattern` matches."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str


#: Fixed values of the contract.
HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)
#: Default patterns; an allow rule overrides block rules. Patterns are tried on the lower-case URL.
PATTERN_RULES = (
    PatternRule(r"[?&]utm_source=feed(&|#|$)", ("utm", "source", "feed"), "block"),
    PatternRule(r"[?&]page=[0-9]+&ref=", ("page", "ref"), "block"),
    PatternRule(r"://m\.[^/?#]*\.com/", ("m", "com"), "block"),
    PatternRule(r"://blog\.[^/?#]*/es/[0-9]+\.html", ("blog", "es"), "block"),  # html may go on, as in html5
    PatternRule(r"://[^/?#]*\.example\.com/en/[0-9]+/", ("example", "com", "en"), "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_rule(host: Column, path: Column, rules: tuple[HostRule, ...], field: str) -> Column:
    """`field` ("rule" or "verdict") of the longest rule that fits; null if none does."""
    out: Column = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, r.host + r.path if field == "rule" else r.verdict).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-case URL."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"), lambda t: t != ""))


def token_frequencies(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many of all URLs hold each of the rules' tokens: at most one row for each token comes back."""
    held = urls.select(F.explode(F.array_intersect(url_tokens(F.col("url")), F.array(*map(F.lit, sorted(tokens))))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def rule_index(rules: tuple[PatternRule, ...], frequency: dict[str, int]) -> dict[str, list[int]]:
    """Rarest token -> rules (by number) filed under it; ties by token."""
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(k)
    return index


def url_filter(pages: DataFrame, host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows `page_id, host, path, rule, verdict, pattern_verdict, n_candidates`, one for each row of pages.

    `rule` is null where no host rule fits; `verdict` is then the patterns': block if a
    block pattern matches and no allow pattern does, else allow. Null URLs, and those
    without `://`, have empty host and path; a long URL is read whole, repeated rows are
    each judged, other columns ignored, and an empty table gives no rows. Rules are a
    parameter: each is a branch of the plan, which suits hundreds of them and not many
    thousands. The plan is a map over pages, with one count of rule tokens before it.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    all_tokens = {t for r in pattern_rules for t in r.tokens}
    index = rule_index(pattern_rules, token_frequencies(urls, all_tokens)) if all_tokens else {}
    host, path = url_parts(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": host_rule(F.col("host"), F.col("path"), host_rules, "rule"), "host_verdict": host_rule(F.col("host"), F.col("path"), host_rules, "verdict")})
    if index:
        filed = F.create_map(*(x for t, ks in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ks)))))
        fetched = F.flatten(F.transform(F.filter(url_tokens(F.col("url")), lambda t: F.map_contains_key(filed, t)), lambda t: filed[t]))
    else:
        fetched = F.array().cast(T.ArrayType(T.IntegerType()))
    out = out.withColumn("candidates", fetched)
    lowered = F.lower(F.col("url"))
    # each pattern is a constant of its own branch, compiled once, behind the test that the URL fetched it
    hit = lambda verdict: F.coalesce(F.greatest(F.lit(False), F.lit(False), *(F.coalesce(F.array_contains("candidates", k) & lowered.rlike(r.pattern), F.lit(False)) for k, r in enumerate(pattern_rules) if r.verdict == verdict)), F.lit(False))
    out = out.withColumn("pattern_verdict", F.when(hit("block") & ~hit("allow"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("host_verdict", "pattern_verdict").alias("verdict"), "pattern_verdict", F.size("candidates").cast("long").alias("n_candidates"))


def oracle(host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same result in SQL, every pattern tried on every URL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"((host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)}))"
    longest = sorted(host_rules, key=lambda r: (-len(r.host) - len(r.path), r.host))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(value(r))}" for r in longest) + " END"
    hits = lambda verdict: "(" + " OR ".join(["false", *(f"coalesce(regexp_matches(lower(url), {quote(r.pattern)}), false)" for r in pattern_rules if r.verdict == verdict)]) + ")"
    return f"""
        WITH rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        ruled AS (SELECT page_id, host, path, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.verdict)} AS host_verdict,
                  CASE WHEN {hits("block")} AND NOT {hits("allow")} THEN 'block' ELSE 'allow' END AS pattern_verdict FROM parts)
        SELECT page_id, host, path, rule, coalesce(host_verdict, pattern_verdict) AS verdict, pattern_verdict FROM ruled"""
