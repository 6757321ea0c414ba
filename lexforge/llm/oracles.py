"""DuckDB SQL for the operators whose work SQL can express step by step."""

from __future__ import annotations


def clusters_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd rounds one after the other: an assignment, then new centroids."""
    kept = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS row_, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND {kept})",
        f"c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS STRING)) NULLS LAST, v) - 1 AS k, v AS c FROM v) WHERE k < {k})",
    ]
    for n in range(rounds + 1):
        away = "list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c)"
        steps.append(f"a{n} AS MATERIALIZED (SELECT row_, vec_id, v, k, c, d FROM (SELECT *, row_number() OVER (PARTITION BY row_ ORDER BY d, k) AS place FROM (SELECT v.*, c{n}.*, {away} AS d FROM v, c{n})) WHERE place = 1)")
        if n < rounds:
            means = f"SELECT k, j, floor(sum(x) / count(*)) AS x FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n}) GROUP BY ALL"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT k, list(x ORDER BY j) AS c FROM ({means}) GROUP BY k UNION ALL SELECT k, c FROM c{n} WHERE k NOT IN (SELECT k FROM a{n}))")
    digest = "sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS STRING)), ','))"
    return f"WITH {', '.join(steps)} SELECT vec_id, CAST(k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, {digest} AS centroid_sha256 FROM a{rounds}"


def repair_sql() -> str:
    """The repair as a fold over the rows of a conversation with the best derivation of each state, in DuckDB."""

    def add(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}} END"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}], 'ASC', 'NULLS LAST')[1]"

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    keep, new_user, new_assistant = (f"chr(10) || {role} || ':' || f.text" for role in ("f.role", "'user'", "'assistant'"))
    free, extra = "coalesce(f.fault, '') NOT IN ('blank', 'duplicate')", "CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END"
    kept = lambda state, initial: when(f"{free} AND left(f.role, 1) = '{initial}'", add(f"r.{state}", extra, "K", keep))
    changed = lambda state, line: when(free, add(f"r.{state}", f"1 + {extra}", "R", line))
    gone = lambda state: add(f"r.{state}", "2", "D")
    before_user = ("st", "sy", "a")
    raw_user = least(gone("u"), *(kept(s, "u") for s in before_user), *(changed(s, new_user) for s in before_user))
    raw = f"{gone('st')} AS st, {least(gone('sy'), kept('st', 's'))} AS sy, {raw_user} AS u0, {least(gone('a'), kept('u', 'a'), changed('u', new_assistant))} AS a0"
    inserted = lambda state, role: add(state, "5", "I", f"chr(10) || '{role}:'")
    grown = least("u0", *(inserted(s, "user") for s in ("st", "sy", "a0")))
    empty = "{'c': 0::BIGINT, 'a': '', 't': ''}"
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(place) + 1), lambda i: ascii(place[i])::BIGINT)), lambda a, b: {byte}), 4294967295)"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' ')) AS place FROM conversations),
    c AS (SELECT *, {crc} % 20 AS kind FROM k),
    d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n, rtrim(text, {blanks}) AS said FROM d),
    f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
      n > 1 AND concat(left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1), left(role, 1)) NOT IN ('su', 'ua', 'au') AS illegal FROM o),
    g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN fault = 'blank' THEN 1 END) AS blank, count(CASE WHEN fault = 'duplicate' THEN 1 END) AS duplicate, count(CASE WHEN fault = 'truncated' THEN 1 END) AS truncated, count(CASE WHEN illegal THEN 1 END) AS illegal, max(n) AS rows_ FROM f GROUP BY conv_id),
    r(conv_id, n, st, sy, u, a) AS (
      SELECT conv_id, 0::BIGINT, st, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)), u, {inserted('u', 'assistant')} FROM (SELECT conv_id, st, {inserted('st', 'user')} AS u FROM (SELECT conv_id, {empty} AS st FROM g))
      UNION ALL
      SELECT conv_id, n, st, sy, u, {least('a0', inserted('u', 'assistant'))} FROM (SELECT *, {grown} AS u FROM (SELECT r.conv_id, f.n, {raw} FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.n = r.n + 1))),
    e AS (SELECT g.*, {least('r.st', 'r.a')} AS best FROM g JOIN r ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.n = g.rows_)
    SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substring(best.t, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM v.conv_id"""
