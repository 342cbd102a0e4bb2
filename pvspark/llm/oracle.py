"""The same results in DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from pvspark.llm import license, quality

SPACES = r"[ \x09-\x0D]+"


def quality_rules(share: float = quality.SHARE, least: int = quality.LEAST, min_left: float = quality.MIN_LEFT) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws FROM d),
windows AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, list_zip(ws[1:len(ws) - 2], ws[2:len(ws) - 1], ws[3:]) AS z FROM w WHERE len(ws) >= 3),
placed AS (SELECT r, i, z[i] AS g FROM windows),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM placed),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, unnest([0, 1, 2]) AS u(k) WHERE n >= 2 GROUP BY r),
lines AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^ \x09-\x0D]') GROUP BY r),
normed AS (
  SELECT r, host, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\p{{L}}0]+', ' ', 'g')) AS norm,
    len(list_filter(string_split_regex(line, '{SPACES}'), lambda x: x <> '')) AS n FROM lines),
sizes AS (SELECT host, count(*) AS documents FROM d GROUP BY host),
common AS (SELECT host, norm FROM normed JOIN sizes USING (host) WHERE norm <> '' GROUP BY host, norm, documents
  HAVING count(DISTINCT r) > {least} AND count(DISTINCT r) > CAST({share} AS DOUBLE) * documents),
gone AS (SELECT r, count(*) AS lines, sum(n) AS words FROM normed JOIN common USING (host, norm) GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(list_aggregate(list_concat([''], ws), 'string_agg', '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.lines, 0) AS BIGINT) AS removed_lines,
    CAST(coalesce(gone.words, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= CAST({min_left} AS DOUBLE) * n_words AS kept
FROM counted"""


def scan_licenses() -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f"ends_with(' ' || s, ' {no} {known}')" for no in license.NEGATIONS)} THEN NULL WHEN s = '{known}' OR ends_with(s, ' {known}') THEN '{name}'"
        for name, known in sorted(license.SENTENCES.items(), key=lambda x: -len(x[1]))
    )
    told = " OR ".join(f"contains(s, '{k}')" for k in license.KEYWORDS)
    steps, last = [], "texts"
    for k, (name, names) in enumerate(license.RULES):
        sequence = "".join(f"<{x}>" for x in names.split())
        steps.append(
            f"rule{k} AS (SELECT r, replace(rest, '{sequence}', '|') AS rest, "
            f"CASE WHEN contains(rest, '{sequence}') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})"
        )
        last = f"rule{k}"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT r, unnest(string_split_regex(t, '{license.ENDS}')) AS p, generate_subscripts(string_split_regex(t, '{license.ENDS}'), 1) AS i FROM d),
normed AS (SELECT r, i, trim(regexp_replace(replace(lower(p), 'licence', 'license'), '[^a-z0-9.]+', ' ', 'g')) AS s FROM parts),
named AS (SELECT r, i, coalesce(CASE {cases} END, '?') AS id FROM normed WHERE {told}),
texts AS (
  SELECT r, string_agg('<' || id || '>', '' ORDER BY i) AS rest, CAST([] AS VARCHAR[]) AS found, count(*) AS n_sentences,
    count(*) FILTER (id <> '?') AS n_known, string_agg(id, ',' ORDER BY i) FILTER (id <> '?') AS sentence_ids FROM named GROUP BY r),
{", ".join(steps)},
tags AS (SELECT r, list_filter(string_split_regex(array_to_string(regexp_extract_all(t, '{license.TAG}', 1), ' '), '{license.BETWEEN}'), lambda x: x NOT IN ('', 'OR', 'AND', 'WITH')) AS names
  FROM d WHERE contains(t, 'SPDX-License-Identifier')),
named_all AS (SELECT d.r, list_concat(coalesce({last}.found, []), list_filter(coalesce(tags.names, []), lambda x: NOT list_contains(coalesce({last}.found, []), x))) AS names
  FROM d LEFT JOIN {last} USING (r) LEFT JOIN tags USING (r)),
once AS (SELECT r, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM named_all)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(sentence_ids, '') AS sentence_ids,
  array_to_string(CASE WHEN len(once.names) > 1 THEN list_filter(once.names, lambda x: x <> 'Proprietary') ELSE once.names END, ',') AS licenses
FROM d LEFT JOIN texts USING (r) JOIN once USING (r)"""


JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
classes AS (SELECT doc_id, coalesce(list(g ORDER BY g), []) AS gs FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id,
  CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY gs) END AS class_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN roots USING (doc_id) LEFT JOIN classes USING (doc_id)"""


CHAT = r"""
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM turns),
grown AS (SELECT conv_id, place, n, string_agg(piece, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed),
whole AS (SELECT prefix AS text, min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies FROM grown WHERE place = n GROUP BY prefix, n)
SELECT conv_id, n_turns, n_copies, text FROM whole
WHERE NOT EXISTS (SELECT 1 FROM grown WHERE grown.place < grown.n AND grown.place = whole.n_turns AND grown.prefix = whole.text)"""



def merkle_manifest(levels: int = 20, languages: int = 8) -> str:
    """Trees of up to 2**levels leaves and 2**languages languages."""
    fields = ("doc_id", "source", "lang", "{n}", "text")
    text = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    leaf = f"sha256({' || '.join(text)})"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {bit})"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT for x in string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: {byte}), 4294967295)"
    steps = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, lang, {leaf.format(n='n_chars')} AS leaf, "
        f"CASE WHEN {crc} % 7 = 0 THEN {leaf.format(n='(n_chars + 1)')} END AS other FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d)",
        "l0 AS MATERIALIZED (SELECT lang, i, n, leaf AS h FROM placed)",
        "f0 AS (SELECT r, doc_id, lang, leaf, i, n, coalesce(other, leaf) AS h, '' AS proof FROM placed)",
    ]
    grow = (
        "{to} AS MATERIALIZED (SELECT {by} i // 2 AS i, max((n + 1) // 2) AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h "
        "FROM {of} GROUP BY {by} i // 2)"
    )
    climb = (
        "{to} AS (SELECT {rest}, f.lang, f.i // 2 AS i, (f.n + 1) // 2 AS n, CASE WHEN f.n = 1 THEN f.h WHEN f.i % 2 = 1 THEN sha256(s.h || f.h) "
        "ELSE sha256(f.h || coalesce(s.h, '')) END AS h, f.proof || coalesce(s.h, '') AS proof FROM {of} f LEFT JOIN {nodes} s ON {same} s.i = xor(f.i, 1))"
    )
    for k in range(levels):
        steps.append(grow.format(to=f"l{k + 1}", of=f"l{k}", by="lang,"))
        steps.append(climb.format(to=f"f{k + 1}", of=f"f{k}", nodes=f"l{k}", same="s.lang IS NOT DISTINCT FROM f.lang AND", rest="r, doc_id, leaf"))
    steps += [
        f"t0 AS MATERIALIZED (SELECT lang, h AS subroot, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM l{levels})",
        f"g0 AS (SELECT r, doc_id, leaf, t.subroot, f.lang, t.i, t.n, f.h, proof FROM f{levels} f JOIN t0 t ON t.lang IS NOT DISTINCT FROM f.lang)",
    ]
    for k in range(languages):
        steps.append(grow.format(to=f"t{k + 1}", of=f"t{k}", by=""))
        steps.append(climb.format(to=f"g{k + 1}", of=f"g{k}", nodes=f"t{k}", same="", rest="r, doc_id, leaf, f.subroot"))
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, g.h AS folded_root, g.h = t.h AS verified "
        f"FROM g{languages} g CROSS JOIN t{languages} t"
    )


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    square = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, len(x) + 1)])::BIGINT"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, z) AS r, * FROM (SELECT vec_id, label, [floor(256 * y::DOUBLE)::BIGINT for y in embedding] AS z "
        f"FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len([1 for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0))",
        f"x AS MATERIALIZED (SELECT r, p, z[p * (len(z) // {parts}) + 1 : (p + 1) * (len(z) // {parts})] AS x FROM v, range({parts}) AS t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': {square}, 'e': e}}) AS best FROM x JOIN c{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            steps += [
                f"s{k} AS (SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) AS t(i) GROUP BY ALL)",
                f"m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e)",
                f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m USING (p, e))",
            ]
    return f"""
WITH {", ".join(steps)},
name AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r) CROSS JOIN name"""


ORACLE = {
    "op1_quality_rules": quality_rules(),
    "op3_license_scan": scan_licenses(),
    "op8_ngram_jaccard": JACCARD,
    "op9_chat_formatting": CHAT,
    "op11_merkle_manifest": merkle_manifest(),
    "op12_vector_codes": vector_codes(),
}
