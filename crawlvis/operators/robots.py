"""robots.txt: groups, the crawler's group, and whether a path is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlvis.functions.fence import let

# The crawlers of the grid.
CRAWLERS = ("GPTBot", "ClaudeBot", "PerplexityBot", "Google-Extended", "CCBot")


def _lines(content: Column) -> Column:
    """array<struct<field, value>> of a file's lines that have a field."""
    bare = F.transform(F.split(F.coalesce(content, F.lit("")), r"\r?\n"), lambda line: F.trim(F.regexp_replace(line, r"#.*$", "")))
    fields = F.filter(bare, lambda line: F.contains(line, F.lit(":")))
    at = lambda line: F.instr(line, ":")
    return F.transform(fields, lambda line: F.struct(F.lower(F.trim(F.substring(line, F.lit(1), at(line) - 1))).alias("field"), F.trim(F.substring(line, at(line) + 1, F.length(line))).alias("value")))


def parsed_lines(files: DataFrame, key: str = "host") -> DataFrame:
    """key, line_no, grp, kind (agent, allow, disallow or sitemap), value: each line with its group.

    files: key, content. Agents in a row share a group; any other field ends the row. Rules before any agent are left out;
    sitemaps have no group.
    """
    rows = files.select(key, F.posexplode(_lines(F.col("content"))).alias("line_no", "line")).select(key, "line_no", "line.*")
    file = Window.partitionBy(key).orderBy("line_no")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("field").over(file) == "user-agent", F.lit(False))
    numbered = rows.withColumn("grp", F.sum(opens.cast("long")).over(file.rowsBetween(Window.unboundedPreceding, 0)))
    kind = F.when(agent, F.lit("agent")).when(F.col("field").isin("allow", "disallow"), F.col("field")).when((F.col("field") == "sitemap") & (F.col("value") != ""), F.lit("sitemap"))
    value = F.when(agent, F.lower("value")).otherwise(F.col("value"))
    rows = numbered.select(key, F.col("line_no").cast("long").alias("line_no"), F.when(kind != "sitemap", F.col("grp")).alias("grp"), kind.alias("kind"), value.alias("value"))
    return rows.where("kind is not null and (kind = 'sitemap' or grp > 0)")


def chosen_groups(lines: DataFrame, key: str = "host") -> DataFrame:
    """key, groups: array<struct<crawler, grp>>: the first group that names a crawler, else the first of whose agents one is part of its name, else the first for all."""
    agents = lines.where("kind = 'agent'")

    def group_for(crawler: str) -> Column:
        name, agent = crawler.lower(), F.col("value")
        tier = F.when(agent == name, 1).when((agent != "*") & F.contains(F.lit(name), agent), 2).when(agent == "*", 3)
        return F.struct(F.lit(crawler).alias("crawler"), F.min(F.when(tier.isNotNull(), F.struct(tier.alias("tier"), "grp")))["grp"].alias("grp"))

    return agents.groupBy(key).agg(F.array(*[group_for(c) for c in CRAWLERS]).alias("groups"))


def compiled(lines: DataFrame, key: str = "host") -> DataFrame:
    """key, grp, prefix, size, allow, anchored, parts of every rule, once.

    ``*`` is anything, a final ``$`` the end. parts: what stands between the stars; prefix: the first of them, which a path
    must begin with, so rules are found by equality and not by trying each.
    """
    rules = lines.where("kind in ('allow', 'disallow') and value <> ''").select(key, "grp", (F.col("kind") == "allow").alias("allow"), F.col("value").alias("rule")).distinct()
    anchored = F.endswith("rule", F.lit("$"))
    body = F.when(anchored, F.substring("rule", F.lit(1), F.length("rule") - 1)).otherwise(F.col("rule"))
    rows = rules.withColumns({"size": F.length("rule"), "anchored": anchored, "parts": F.split(body, r"\*")})
    return rows.select(key, "grp", F.get("parts", F.lit(0)).alias("prefix"), "size", "allow", "anchored", "parts")


def matches(path: Column, parts: Column, anchored: Column) -> Column:
    """Whether a path that begins with the first of ``parts`` has the others behind it in order, the last at its end if ``anchored``.

    Each part is looked for from where the one before it ended, so a path is read once.
    """
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    between = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1 - anchored.cast("int"), F.lit(0)))
    found = lambda at, part: F.when(at == 0, at).otherwise(let(F.position(part, path, at), lambda i: F.when(i == 0, i).otherwise(i + F.length(part))))
    reached = F.aggregate(between, F.length(first) + 1, found)
    ends = F.when(F.size(parts) == 1, path == first).otherwise(let(reached, lambda at: (at > 0) & F.endswith(path, last) & (F.length(path) - F.length(last) + 1 >= at)))
    return F.when(anchored, ends).otherwise(reached > 0)


def verdicts(paths: DataFrame, lines: DataFrame, key: str = "host") -> DataFrame:
    """key, path, rules: array<struct<grp, allow>> of the groups of which some rule matches: the longest decides, an allowing one on a tie.

    All rules of a file meet all paths of its host in one join, of paths' beginnings with rules' literal ones; only the
    lengths that a host's rules have are tried. Groups that no crawler goes by are left out.
    """
    groups = chosen_groups(lines, key).select(key, F.explode("groups").alias("g")).select(key, "g.grp").where("grp is not null").distinct()
    rules = compiled(lines, key).join(groups, [key, "grp"], "left_semi")
    sizes = rules.groupBy(key).agg(F.collect_set(F.length("prefix")).alias("sizes"))
    each = paths.select(key, "path").where(F.col(key).isNotNull() & F.col("path").isNotNull()).distinct().join(sizes, key)
    each = each.select(key, "path", F.explode(F.filter("sizes", lambda n: n <= F.length("path"))).alias("n")).select(key, "path", F.substring("path", F.lit(1), F.col("n")).alias("prefix"))
    hits = each.join(rules, [key, "prefix"]).where(matches(F.col("path"), F.col("parts"), F.col("anchored")))
    best = hits.groupBy(key, "path", "grp").agg(F.max(F.struct("size", "allow"))["allow"].alias("allow"))
    return best.groupBy(key, "path").agg(F.collect_list(F.struct("grp", "allow")).alias("rules"))


def grid(pages: DataFrame, files: DataFrame, key: str = "host") -> DataFrame:
    """pages with robots_grid: array<struct<crawler, allowed>>, robots_present and sitemaps. pages: key, path, …

    A file is parsed once for all pages and crawlers. No rule allows, nor does a missing file forbid.
    """
    lines = parsed_lines(files, key)
    maps = lines.where("kind = 'sitemap'").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda m: m["value"]).alias("sitemaps"))
    known = files.select(key, F.col("content").isNotNull().alias("robots_present")).join(chosen_groups(lines, key), key, "left").join(maps, key, "left")
    rows = pages.join(known, key, "left").join(verdicts(pages, lines, key), [key, "path"], "left")

    def cell(crawler: str) -> Column:
        grp = F.get(F.filter("groups", lambda g: g["crawler"] == crawler), F.lit(0))["grp"]
        return F.struct(F.lit(crawler).alias("crawler"), F.coalesce(F.get(F.filter("rules", lambda r: r["grp"] == grp), F.lit(0))["allow"], F.lit(True)).alias("allowed"))

    none = F.array().cast("array<string>")
    return rows.withColumns({"robots_grid": F.array(*[cell(c) for c in CRAWLERS]), "robots_present": F.coalesce("robots_present", F.lit(False)), "sitemaps": F.coalesce("sitemaps", none)}).drop("groups", "rules")
