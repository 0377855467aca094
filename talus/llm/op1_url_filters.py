"""URL filters with redirect equivalence.

Rules (host, path, verdict) fit a url whose host is the rule's or a subdomain of it and whose path starts with the rule's;
the rule with the longest ``host + path`` counts, of equals an allow rule, then the first in order. Urls that redirects or
canonical links connect are aliases: connected components are found by contraction over the edge table, and a url that no
rule fits is blocked if any alias of it, fetched or not, is blocked by a rule. An explicit allow rule goes before what aliases
say, so an allowed url stays allowed. Urls with neither rule nor blocked alias are allowed.

Host: what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; path: then up to ``?``,
``#`` or the end. Null urls and urls without ``://`` have both empty, and no alias. Aliases are compared as host, path and
query, without scheme and fragment. Repeated rows are judged alike, one by one.

Up to ``compiled`` rules become one column expression; more are joined on the suffixes of distinct hosts. The rules are the
caller's list, so their number is known: up to ``broadcast`` of them the table of rules is broadcast, and a suffix that a
third of all hosts have is no hot key; more are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.llm.batches import restore, shield
from talus.llm.components import connected_components
from talus.llm.storage import keep

COMPILED = 200
BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def alias_key(url: Column) -> Column:
    """Host, path and query; null where there is no host."""
    host = host_of(url)
    rest = F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) alias keys from the canonical links and the immediate redirects (meta refresh) in html of pages (url,
    html). Targets without a host are resolved against the page's url."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0))
    tags = pages.select("url", "html").where("html is not null and (instr(lower(html), 'canonical') > 0 or instr(lower(html), 'refresh') > 0)")
    tags = tags.select("url", tag.alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?i)\brel\s*=\s*["']?canonical\b"""), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    refresh = F.when(F.col("tag").rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    targets = keep(tags.select("url", F.coalesce(canonical, refresh).alias("to")).where("to != ''"), "targets")
    scheme = F.regexp_extract("url", r"^[^:]*:", 0)
    folder = F.regexp_extract(path_of(F.col("url")), r"(?s)^.*/", 0)
    whole = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("//"), host_of(F.col("url")), "to"))
        .otherwise(F.concat(scheme, F.lit("//"), host_of(F.col("url")), F.when(folder == "", F.lit("/")).otherwise(folder), "to"))
    )
    keys = keep(targets.select(alias_key(F.col("url")).alias("src"), whole.alias("to")), "targets")
    return keys.select("src", alias_key(F.col("to")).alias("dst")).where("src is not null and dst is not null")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def apply_rules(rows: DataFrame, rules: list[tuple[str, str, str]], compiled: int = COMPILED, broadcast: int = BROADCAST) -> DataFrame:
    """rows (with host and path) with rule and rule_verdict, null where none fits; rules: (host, path, allow or block)."""
    order = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    if len(order) <= compiled:
        best = F.lit(None).cast("struct<rule:string,verdict:string>")
        for h, p, v in reversed(order):
            fit = _fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p))
            best = F.when(fit, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(best)
        return rows.withColumn("_best", best).select(*rows.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))
    table = rows.sparkSession.createDataFrame([(h, p, v, k) for k, (h, p, v) in enumerate(order)], "suffix string, rule_path string, verdict string, place int")
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    distinct = rows.select("host", "path").distinct()
    met = distinct.select("host", "path", F.explode(suffixes).alias("suffix")).join(F.broadcast(table) if len(order) <= broadcast else table, "suffix").where(F.startswith("path", "rule_path"))
    first = met.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("suffix", "rule_path").alias("rule"), "verdict"), "place").alias("_best"))
    return rows.join(first, ["host", "path"], "left").select(*rows.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict"))


def _judged(rows: DataFrame, url: str, rules: list, compiled: int) -> DataFrame:
    kept = [c for c in rows.columns if c.lower() not in ("host", "path", "rule", "rule_verdict")]
    return apply_rules(rows.select(*kept, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")), rules, compiled)


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame, compiled: int = COMPILED) -> DataFrame:
    """urls (with url) with host, path, rule, verdict and from_alias (an alias decided). Columns of those names are replaced.

    edges: (src, dst) alias keys, as page_edges() makes them."""
    groups = connected_components(edges)
    blocked_by = _blocked_aliases(edges, groups, rules, compiled)
    need, added = ("url",), ("host", "path", "rule", "verdict", "from_alias")
    judged = _judged(shield(urls, need), "url", rules, compiled).withColumn("_key", alias_key(F.col("url")))
    judged = judged.join(blocked_by, F.col("_key") == F.col("_alias"), "left")
    by_alias = F.col("rule_verdict").isNull() & F.col("_alias").isNotNull()
    verdict = F.coalesce("rule_verdict", F.when(F.col("_alias").isNotNull(), F.lit("block")), F.lit("allow"))
    return restore(judged.withColumns({"verdict": verdict, "from_alias": by_alias}), urls, need, added)


def _blocked_aliases(edges: DataFrame, groups: DataFrame, rules: list, compiled: int) -> DataFrame:
    """Each alias key whose component holds a url that a rule blocks."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("_node")).distinct()
    nodes = nodes.join(groups, F.col("_node") == F.col("node"), "left").select("_node", F.coalesce("component", "_node").alias("_group"))
    judged = _judged(nodes.withColumn("_url", F.concat(F.lit("http://"), "_node")), "_url", rules, compiled)
    bad = judged.where("rule_verdict = 'block'").select("_group").distinct()
    return nodes.join(bad, "_group", "left_semi").select(F.col("_node").alias("_alias"))
