"""URL parts, canonical URLs and rules, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change what a server returns.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host/path?query without scheme, `www.`, default port, fragment, tracking parameters or a
    trailing slash, parameters sorted; null where there is no `://`."""
    site = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    asked = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    where = F.regexp_replace(path(url), r"/$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(site, F.when(where == "", F.lit("/")).otherwise(where), query))


def longest_rule(site: Column, where: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of rules (host, path, verdict) that fits; nulls if none does.
    A rule fits its host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last test written is the first asked
        fits = ((site == h) | site.endswith("." + h)) & where.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
#: The same parts for DuckDB, over a column named url.
SQL_HOST = f"coalesce(translate(regexp_extract({_REST}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '')"
SQL_PATH = f"coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '')"
_SITE = f"regexp_replace(regexp_replace({SQL_HOST}, ':(80|443)$', ''), '^www\\.', '')"
_KEPT = f"list_sort(list_filter(string_split(regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}')))"
_WHERE = f"regexp_replace({SQL_PATH}, '/$', '')"
SQL_CANONICAL = f"CASE WHEN strpos(url, '://') > 0 THEN {_SITE} || CASE WHEN {_WHERE} = '' THEN '/' ELSE {_WHERE} END || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END END"
