"""SQL of the filter audit and the manifest, which takes neither transform nor tree tables of the operators."""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END) AS failed
  FROM d LEFT JOIN l USING (doc_id)
),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || e.x || h.x AS filter_order FROM x a, x b, x c, x e, x h
  WHERE len(list_distinct([a.x, b.x, c.x, e.x, h.x])) = 5
),
s AS (SELECT part, failed, n, good, toxic, filter_order, list_min(list_transform(string_split(failed, ''), lambda c: CASE WHEN c = '' THEN 9 ELSE instr(filter_order, c) END)) AS hit FROM g, o),
k AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substring(filter_order, CAST(step AS INTEGER), 1) AS letter FROM o, unnest(range(1, 6)) AS u(step)),
v AS (SELECT part, substring(filter_order, hit, 1) AS letter, sum(n) AS shapley FROM s WHERE hit < 9 GROUP BY ALL),
r AS (
  SELECT part, s.filter_order, step, letter, sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit < step AND contains(failed, letter) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM s JOIN k USING (filter_order) GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM r LEFT JOIN v USING (part, letter)
"""


def _tree(rows: str, name: str, height: int) -> str:
    """Common tables of ``height`` levels over ``rows`` (grp, i, size, hash): ``name_n{k}`` has the nodes of level k and ``name_r{k}`` the runs that they stand in."""
    out = [f"{name}_n0 AS MATERIALIZED ({rows})"]
    for k in range(height):
        out.append(f"{name}_r{k} AS MATERIALIZED (SELECT grp, i // 8 AS run, list(hash ORDER BY i) AS hashes FROM {name}_n{k} WHERE size > 1 GROUP BY ALL)")
        out.append(f"{name}_n{k + 1} AS MATERIALIZED (SELECT grp, run AS i, (size + 7) // 8 AS size, sha256(array_to_string(hashes, '')) AS hash FROM {name}_r{k} JOIN (SELECT DISTINCT grp, size FROM {name}_n{k}) USING (grp))")
    return ",\n".join(out)


def _climb(rows: str, name: str, out: str, height: int) -> str:
    """``rows`` (with grp, i, proof, fold) carried up the tree, level by level."""
    steps, last = [], rows
    for k in range(height):
        here = f"{out}_{k}"
        steps.append(
            f"{here} AS MATERIALIZED (SELECT c.* EXCLUDE (i, proof, fold), c.i // 8 AS i, CASE WHEN hashes IS NULL THEN proof ELSE proof || array_to_string(hashes[:c.i % 8], '') || array_to_string(hashes[c.i % 8 + 2:], '') END AS proof, "
            f"CASE WHEN hashes IS NULL THEN fold ELSE sha256(array_to_string(hashes[:c.i % 8], '') || fold || array_to_string(hashes[c.i % 8 + 2:], '')) END AS fold "
            f"FROM {last} c LEFT JOIN {name}_r{k} r ON r.grp = c.grp AND r.run = c.i // 8)"
        )
        last = here
    return ",\n".join(steps)


def manifest_sql(height: int = 8, crown: int = 3) -> str:
    """Trees of at most ``height`` levels below the groups' nodes, and of ``crown`` levels above."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || {field(text)})"
    crc = "xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    union = " UNION ALL ".join(f"SELECT grp, hash FROM a_n{k} WHERE size = 1" for k in range(height + 1))
    top = " UNION ALL ".join(f"SELECT hash AS root FROM b_n{k} WHERE size = 1" for k in range(crown + 1))
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS grp, {row('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {row(lower)} END AS presented FROM documents
), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS size FROM d),
{_tree("SELECT grp, i, size, leaf AS hash FROM e", "a", height)},
t AS MATERIALIZED ({union}),
u AS MATERIALIZED (SELECT grp AS name, 1 AS grp, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS size, hash FROM t),
{_tree("SELECT grp, i, size, hash FROM u", "b", crown)},
root AS MATERIALIZED ({top}),
c AS MATERIALIZED (SELECT doc_id, leaf, grp, i, '' AS proof, coalesce(presented, leaf) AS fold FROM e),
{_climb("c", "a", "up", height)},
m AS MATERIALIZED (SELECT c.doc_id, c.leaf, u.hash AS subroot, u.grp, u.i, c.proof, c.fold FROM up_{height - 1} c JOIN u ON u.name = c.grp),
{_climb("m", "b", "high", crown)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM high_{crown - 1}, root
"""


def personal_sql(near: int, least: int, support: int, slack: float, prefixes: tuple[int, ...]) -> str:
    """Spans by the plain forms, and the terms that disclose them, word by word without buckets or chunks."""
    lens = ", ".join(map(str, prefixes))
    # Matches and the text between them: a match begins after all that lies before it.
    found = lambda kind, pattern, good: (
        f"{kind}m AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM d WHERE regexp_matches(t, '{pattern}')),\n"
        f"{kind}a AS (SELECT doc_id, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS k, m, p FROM {kind}m),\n"
        f"{kind} AS (SELECT doc_id, '{kind}' AS kind, v, length(array_to_string(p[:k], '')) + length(array_to_string(m[:k - 1], '')) AS s FROM {kind}a WHERE {good})"
    )
    digits = "regexp_replace(v, '[^0-9]+', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"
    email, ip = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)"
    card, phone = "[0-9](?:[\\x20-]?[0-9])+", "\\+[0-9][\\x20().0-9-]+[0-9]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{found("email", email, "true")},
{found("ip", ip, "len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0")},
{found("card", card, f"length({digits}) BETWEEN 16 AND 19 AND {luhn}")},
{found("phone", phone, f"length({digits}) BETWEEN 8 AND 15")},
base AS (SELECT *, s + length(v) AS e FROM (SELECT * FROM email UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM card UNION ALL SELECT * FROM phone)),
blank AS (
  SELECT d.doc_id, d.t, CASE WHEN m IS NULL THEN d.t ELSE array_to_string(list_transform(p, lambda x, i: x || coalesce(repeat(' ', length(m[i])), '')), '') END AS b
  FROM d LEFT JOIN emailm USING (doc_id)
),
wm AS (SELECT doc_id, t, regexp_extract_all(b, '[\\p{{L}}\\p{{M}}]+') AS m, string_split_regex(b, '[\\p{{L}}\\p{{M}}]+') AS p FROM blank),
wl AS (SELECT doc_id, t, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS k, unnest(p[:len(m)]) AS gap FROM wm),
w AS (
  SELECT doc_id, t, lower(v) AS term, sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY k) - length(v) AS s, length(v) AS n FROM wl
),
words AS (SELECT doc_id, t, term, s, s + n AS e FROM w WHERE n >= {least}),
pairs AS (
  SELECT DISTINCT w.doc_id, w.t, b.kind || ':' || b.v AS entity, w.term, w.s FROM base b JOIN words w USING (doc_id)
  WHERE (w.s >= b.s - {near} AND w.e <= b.s) OR (w.s >= b.e AND w.e <= b.e + {near})
),
forms AS (
  SELECT DISTINCT term, unnest(list_concat([term], list_transform(list_filter([{lens}], lambda n: length(term) > n), lambda n: substring(term, 1, n) || '*'))) AS form FROM words
),
near AS (SELECT entity, form, count(*) AS n_near FROM pairs JOIN forms USING (term) GROUP BY ALL HAVING count(DISTINCT t) >= {support}),
most AS (SELECT form, max(n_near) AS n_near FROM near GROUP BY form),
total AS (SELECT form, count(*) AS n FROM words JOIN forms USING (term) SEMI JOIN most USING (form) GROUP BY form),
told AS (SELECT form FROM most JOIN total USING (form) WHERE n_near >= n * pow(2, -{slack})),
spans AS (
  SELECT doc_id, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 ELSE 4 END AS o, kind, s, e FROM base
  UNION ALL SELECT doc_id, 5, 'term', s, e FROM words SEMI JOIN told ON told.form = words.term
),
lists AS (
  SELECT doc_id, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone, count(*) FILTER (o = 5) AS n_terms,
    coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s) FILTER (o < 5), '') AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM d LEFT JOIN lists USING (doc_id)
"""
