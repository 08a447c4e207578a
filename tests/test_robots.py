"""Rules of robots files against a plain reading, pattern by pattern."""

import random
import re

from pyspark.sql import functions as F

from crawlvis.operators import robots


def pattern(rule):
    whole = ".*".join(re.sub(r"[.+?^${}()|[\]\\]", lambda m: "\\" + m[0], part) for part in rule.split("*"))
    return re.compile("^" + whole[:-2] + "$" if whole.endswith("\\$") else "^" + whole)


def groups_of(content):
    groups, current, last = [], None, False
    for line in re.split(r"\r?\n", content):
        name, colon, value = re.sub("#.*$", "", line).strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not last:
                current = ([], [])
                groups.append(current)
            current[0].append(value.lower())
        elif name in ("allow", "disallow") and current and value:
            current[1].append((len(value), name == "allow", pattern(value)))
        last = name == "user-agent"
    return groups


def allowed(groups, crawler, path):
    name = crawler.lower()
    tests = (lambda a: a == name, lambda a: a != "*" and a in name, lambda a: a == "*")
    group = next((g for test in tests for g in groups if any(map(test, g[0]))), None)
    hits = [(size, allow) for size, allow, p in (group[1] if group else ()) if p.search(path)]
    return max(hits)[1] if hits else True


def test_rules_equal_patterns(spark):
    r = random.Random(5)
    parts, names = ["a", "b", "ab", "*", "/", "$", "x.", "c?"], ["*", "GPTBot", "claude", "bot", "", "ccbot", "google-extended"]
    files = [("none", None), ("empty", "")]
    for h in range(12):
        lines = []
        for _ in range(r.randint(0, 4)):
            lines += ["User-agent: " + r.choice(names) for _ in range(r.randint(1, 2))]
            lines += [r.choice(["Allow: ", "Disallow: "]) + r.choice(["", "/", "/*"]) + "".join(r.choice(parts) for _ in range(r.randint(0, 5))) for _ in range(r.randint(0, 12))]
        files.append((f"h{h}", "\n".join(lines)))
    files.append(("large", "User-agent: *\n" + "\n".join(f"Disallow: /{i}/*{i % 7}$" if i % 3 else f"Allow: /{i}/x" for i in range(10_000))))
    pages = [(f"h{r.randint(0, 13)}", "/" + "".join(r.choice(["a", "b", "ab", "/", "x.", "c?", "$", "c"]) for _ in range(r.randint(0, 6)))) for _ in range(200)]
    pages += [("large", f"/{r.randint(0, 10_000)}/x{r.randint(0, 9)}") for _ in range(30)] + [("none", "/"), ("empty", "/"), (None, "/"), ("h1", None)] + [("h2", "/a")] * 2
    rows = robots.grid(spark.createDataFrame(pages, "host string, path string"), spark.createDataFrame(files, "host string, content string")).collect()
    read = {host: groups_of(content or "") for host, content in files}
    assert len(rows) == len(pages)
    for row in rows:
        for cell in row["robots_grid"]:
            assert cell["allowed"] == (row["path"] is None or allowed(read.get(row["host"], []), cell["crawler"], row["path"])), (row["host"], row["path"], cell)


def test_a_file_is_matched_by_equality(spark):
    pages, files = spark.createDataFrame([("h", "/a/b")], "host string, path string"), spark.createDataFrame([("h", "User-agent: *\nDisallow: /a\nSitemap: https://h/s.xml")], "host string, content string")
    row = robots.grid(pages, files).first()
    assert row["sitemaps"] == ["https://h/s.xml"] and row["robots_present"] and not any(c["allowed"] for c in row["robots_grid"])
    plan = robots.verdicts(pages, robots.parsed_lines(files))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert robots.grid(pages, files.limit(0)).select(F.size(F.filter("robots_grid", lambda c: c["allowed"]))).first()[0] == len(robots.CRAWLERS)
