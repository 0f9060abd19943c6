"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import html, langid, manifest, mixing, personal, pieces, quality, rules, secrets, simhash, suffixes, turns, vectors


def queries() -> dict[str, Callable]:
    return {
        "op10_html": html.op10_html,
        "op11_manifest": manifest.op11_manifest,
        "op12_turns": turns.op12_turns,
        "op13_personal": personal.op13_personal,
        "op1_vectors": vectors.op1_vectors,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_quality": quality.op3_quality,
        "op4_rules": rules.op4_rules,
        "op5_mixing": mixing.op5_mixing,
        "op6_langid": langid.op6_langid,
        "op7_suffixes": suffixes.op7_suffixes,
        "op8_secrets": secrets.op8_secrets,
        "op9_simhash": simhash.op9_simhash,
    }


WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

#: The same mix without a schedule: each source's shuffled stream of words is gone through until its target is met.
MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5('5-' || CAST(doc_id AS VARCHAR)) AS o FROM documents),
n AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][no % 3 + 1] AS DOUBLE) AS w, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS mix FROM n),
l AS (SELECT *, (CAST(mix AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT no, source, source_size, least(CAST(cap AS DOUBLE), w * (SELECT level FROM l WHERE level <= cap / w ORDER BY cap / w, no LIMIT 1)) AS target FROM l),
g AS (SELECT *, CAST(floor(target + 0.5::DOUBLE) AS BIGINT) AS goal FROM t),
s AS (SELECT d.doc_id, d.size, g.source_size, g.target, goal // greatest(source_size, 1) AS full_rounds, goal % greatest(source_size, 1) AS rest,
 CAST(coalesce(sum(size) OVER (PARTITION BY no ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * full_rounds + greatest(least(start + size, rest) - start, 0) AS BIGINT) AS taken FROM s"""

#: Every string of 400 bytes, in hexadecimal, counted.
REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM n)),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
p AS (SELECT s.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0))) AS before FROM s JOIN n USING (doc_id)),
k AS (SELECT doc_id, string_agg(before, '' ORDER BY a) AS kept, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS spans FROM p GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM n LEFT JOIN k USING (doc_id)"""


#: crc32 of a column's ASCII text: eight shifts for each character.
CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN x = '' THEN CAST([] AS BIGINT[]) ELSE [CAST(ascii(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] END))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"

#: Levels go up in one recursion and each leaf's path in another.
TREES = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE len(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
 || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE len(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head FROM documents),
l AS (SELECT doc_id, coalesce('s' || lang, 'n') AS tree, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
 CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END) END AS bent FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM l),
u AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM b
 UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY tree, level, idx // 8, n),
r AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT 'top' AS tree, 0 AS level, idx, subroot AS h, n FROM r
 UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (n + 7) // 8 FROM v WHERE n > 1 GROUP BY tree, level, idx // 8, n),
s AS (SELECT tree, level, idx, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS z
 FROM (SELECT * FROM u UNION ALL SELECT * FROM v) WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, idx // 8 ORDER BY idx)),
h AS (SELECT tree, max(level) + 1 AS height FROM s GROUP BY 1),
w AS (SELECT row_number() OVER () AS id, b.doc_id, b.leaf, coalesce(b.bent, b.leaf) AS now, b.tree, b.idx, r.idx AS top_idx, r.subroot, coalesce(h.height, 0) AS height FROM b JOIN r USING (tree) LEFT JOIN h ON h.tree = b.tree),
f AS (SELECT id, 0 AS step, now, '' AS proof FROM w
 UNION ALL SELECT f.id, step + 1, sha256(s.a || f.now || s.z), proof || s.a || s.z FROM f JOIN w USING (id) JOIN s
  ON s.tree = CASE WHEN step < height THEN w.tree ELSE 'top' END AND s.level = CASE WHEN step < height THEN step ELSE step - height END AND s.idx = CASE WHEN step < height THEN w.idx // CAST(pow(8, step) AS BIGINT) ELSE top_idx // CAST(pow(8, step - height) AS BIGINT) END),
e AS (SELECT id, max_by(now, step) AS folded, max_by(proof, step) AS proof FROM f GROUP BY 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM w JOIN e USING (id), (SELECT h AS root FROM v WHERE n = 1)"""


def _least(*ways: tuple[str, str, str]) -> str:
    """The least of several elements (state, cost, letters); an element is its cost in nine digits and its audit."""
    return "least(" + ", ".join(f"printf('%09d', CAST({e}[1:9] AS BIGINT) + {c}) || {e}[10:] || '{a}'" if a or c != "0" else e for e, c, a in ways) + ")"


def _closed() -> str:
    """Insertions after a turn: one to the next state, two to the one after it."""
    u = _least(("u0", "0", ""), ("n0", "2", "I"), ("s0", "2", "I"), ("a0", "2", "I"))
    a = _least(("a0", "0", ""), ("u0", "2", "I"), ("n0", "4", "II"), ("s0", "4", "II"))
    return f"n0 AS n, s0 AS s, {u} AS u, {a} AS a"


def _step(own: str, *before: str) -> str:
    """A state after a turn, before insertions: the turn deleted, kept or reroled."""
    free = "CASE WHEN gone THEN NULL ELSE {0} END"
    ways = [(own, "3", "D")]
    for e in before:
        if own in "ua":
            ways.append((f"({free.format(e)})", "2 + cut", "R"))
        ways.append((f"({free.format(f'CASE WHEN i = {chr(39)}{own}{chr(39)} THEN {e} END')})", "cut", "K"))
    return _least(*ways)


#: The four states go through each conversation turn by turn; then the audit's letters are dealt to its turns.
TURNS = f"""WITH RECURSIVE k AS (SELECT *, {CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0 FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE r0 END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t0, '[.!?]', '', 'g') ELSE t0 END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS no FROM m),
j AS (SELECT *, left(role, 1) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY no) > 1 AS dup,
 NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY no) AS before FROM o),
x AS (SELECT *, blank OR dup AS gone, CAST(open AS INTEGER) AS cut FROM j),
c AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(blank) AS blank, count_if(dup AND NOT blank) AS duplicate, count_if(open AND NOT gone) AS truncated,
 count_if(before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT conv_id, 0 AS no, '000000000' AS n, CAST(NULL AS VARCHAR) AS s, '000000002I' AS u, '000000004II' AS a FROM c
 UNION ALL SELECT conv_id, no, {_closed()} FROM (SELECT p.conv_id, x.no, {_least(("n", "3", "D"))} AS n0, {_step("s", "n")} AS s0, {_step("u", "n", "s", "a")} AS u0, {_step("a", "u")} AS a0 FROM p JOIN x ON x.conv_id IS NOT DISTINCT FROM p.conv_id AND x.no = p.no + 1)),
q AS (SELECT p.conv_id, c.*EXCLUDE conv_id, least(p.n, p.a) AS e FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.no = c.n),
y AS (SELECT conv_id, unnest(range(1, len(e) - 8)) AS pos, e[9 + pos] AS edit FROM q),
z AS (SELECT *, CASE WHEN edit <> 'I' THEN count_if(edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) END AS no, count_if(edit <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM y),
g AS (SELECT z.conv_id, z.pos, edit, nth, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role, max(edit = 'K' AND i = 's') OVER (PARTITION BY z.conv_id) AS sys FROM z LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id AND x.no = z.no WHERE edit <> 'D'),
t AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (nth - CAST(coalesce(sys, false) AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM g GROUP BY 1)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(e[1:9] AS BIGINT), 0) AS cost, coalesce(e[10:], '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM v.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_manifest": TREES, "op12_turns": TURNS, "op5_mixing": MIXING, "op7_suffixes": REPEATS}
