"""SQL for DuckDB that states the same results plainly: every rule on every URL, every sequence length by window."""

from __future__ import annotations

from glucoframe.llm import licenses

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines(text: str) -> str:
    lower = f"replace(translate({text}, '{UPPER}', '{LOWER}'), '(c)', '©')"
    line = r"(^|\n)[^a-z0-9\n]*(?:(?:copyright|©)[^a-z0-9\n]*[0-9]{4}|all rights reserved)[^\n]*"
    plain = f"replace(regexp_replace({lower}, '{line}', '\\1', 'g'), '©', ' c ')"
    out = rf"regexp_replace({plain}, '[^a-z0-9\x80-\x{{10FFFF}}\n]+', ' ', 'g')"
    for found, kept in (
        ("(licen)[cs](?:e|ing)", 1), ("(fav|hon|lab)ou?r", 1), ("(author|organ|recogn)i[sz]", 1), ("(cent)(?:er|re)", 1), ("(acknowledg|judg)ement", 1),
        ("(non) commercial", 1), ("(merchant)[ai]bility", 1), ("(wil)l?ful", 1), ("(http)s", 1),
    ):
        out = f"regexp_replace({out}, '{found}', '\\{kept}', 'g')"
    return out


def _license_sql() -> str:
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in licenses.KNOWN.items() for text in texts)
    joined = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH known AS (SELECT sha256({joined.format(_canonical_lines('t'))}) AS known, min(l) AS license FROM (VALUES {known}) AS k(l, t) GROUP BY 1),
docs AS (SELECT doc_id, {_canonical_lines("coalesce(text, '')")} AS lines FROM documents),
digests AS (SELECT doc_id, lines, sha256({joined.format('lines')}) AS text_digest FROM docs),
lines AS (SELECT DISTINCT text_digest, trim(unnest(string_split(lines, chr(10)))) AS line FROM digests),
named AS (SELECT text_digest, list_sort(list(DISTINCT license)) AS notices FROM lines JOIN known ON sha256(line) = known WHERE line <> '' GROUP BY 1)
SELECT doc_id, d.text_digest, license, coalesce(array_to_string(notices, ','), '') AS notices
FROM digests d LEFT JOIN known ON d.text_digest = known LEFT JOIN named n ON n.text_digest = d.text_digest"""


def _quality_sql() -> str:
    shares = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    sizes = [3, *shares]
    gram = lambda n: "concat_ws(' ', " + ", ".join(f"lead(word, {k}) OVER w" if k else "word" for k in range(n)) + ")"
    grams = ", ".join(f"CASE WHEN p + {n - 1} <= n THEN {gram(n)} END AS g{n}" for n in sizes)
    again = "g3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g3) > 1 AS r3, "
    again += ", ".join(f"g{n} IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g{n} ORDER BY p) > 1 AS r{n}" for n in shares)
    inside = ", ".join(f"coalesce(bool_or(r{n}) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), false) AS c{n}" for n in sizes)
    chars = ", ".join(f"sum(CASE WHEN c{n} THEN length(word) ELSE 0 END)::BIGINT AS repeat_chars_{n}" for n in shares)
    names = ", ".join(f"coalesce(repeat_chars_{n}, 0) AS repeat_chars_{n}" for n in shares)
    rules = " AND ".join(f"repeat_chars_{n} <= greatest(word_chars * {most}::DOUBLE, 60)" for n, most in shares.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p, len(words) AS n FROM docs),
grams AS (SELECT *, {grams} FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
again AS (SELECT *, {again} FROM grams),
inside AS (SELECT *, {inside} FROM again),
word_sums AS (SELECT doc_id, sum(length(word))::BIGINT AS word_chars, sum(c3::INT)::BIGINT AS n_repeat_words, {chars} FROM inside GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
line_groups AS (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
line_sums AS (
    SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(n * length(line))::BIGINT AS line_chars, sum(n - 1)::BIGINT AS n_dup_lines,
        sum((n - 1) * length(line))::BIGINT AS dup_line_chars FROM line_groups GROUP BY doc_id),
counts AS (
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {names}, coalesce(n_lines, 0) AS n_lines,
        coalesce(line_chars, 0) AS line_chars, coalesce(dup_line_chars, 0) AS dup_line_chars
    FROM docs LEFT JOIN word_sums USING (doc_id) LEFT JOIN line_sums USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM counts)
SELECT *, NOT base_failed AND {rules} AND n_dup_lines <= greatest(n_lines * 0.3::DOUBLE, 1) AND dup_line_chars <= greatest(line_chars * 0.2::DOUBLE, 60) AS kept
FROM judged"""


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# 160 bits in eight groups of twenty, each of which is five hexadecimal and four base-32 digits.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS sha, min(page_id) OVER (PARTITION BY sha1(payload)) AS least FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
        substr('{BASE32}', (((('0x' || substr(sha, 1 + 5 * i, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM d"""


def _url_sql() -> str:
    piece = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)(([^?#]*).*)$', {})"
    begin, end = r"^([^/?#]*\.)?", r"([^A-Za-z0-9_.%-]|\z)"
    patterns = [(f"||{name}.", "block", begin + name.replace("-", r"\-") + r"\.") for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track", "doubleclick")]
    patterns += [("/ads/", "block", "/ads/"), ("/banner/*.gif", "block", r"/banner/.*\.gif"), ("^click?id=", "block", end + r"click\?id=")]
    patterns.append(("@@||example.org^*/help/", "allow", begin + r"example\.org" + end + ".*/help/"))
    rows = ", ".join(f"('{rule}', '{verdict}', '(?s){regex}')" for rule, verdict, regex in patterns)
    return f"""
WITH u AS (SELECT page_id, translate({piece.format(1)}, '{UPPER}', '{LOWER}') AS host, {piece.format(3)} AS path, {piece.format(2)} AS rest FROM pages),
prefixes AS (
    SELECT *, length(rule) AS size FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
        ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS r(rule, domain, start, verdict)),
patterns AS (SELECT * FROM (VALUES {rows}) AS r(rule, verdict, regex)),
fits AS (
    SELECT page_id, host, path,
        (SELECT max({{'size': size, 'rule': rule, 'verdict': verdict}}) FROM prefixes WHERE (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)) AS p,
        (SELECT max(rule) FROM patterns WHERE verdict = 'allow' AND host || rest <> '' AND regexp_matches(translate(host || rest, '{UPPER}', '{LOWER}'), regex)) AS allowing,
        (SELECT max(rule) FROM patterns WHERE verdict = 'block' AND host || rest <> '' AND regexp_matches(translate(host || rest, '{UPPER}', '{LOWER}'), regex)) AS blocking
    FROM u)
SELECT page_id, host, path, p.rule AS rule, coalesce(p.verdict, CASE WHEN allowing IS NULL AND blocking IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN p IS NULL THEN coalesce(allowing, blocking) END AS pattern
FROM fits"""


MIX_SQL = f"""
WITH docs AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
narrow AS (SELECT *, CASE WHEN size < 100 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS odds FROM docs),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM narrow GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight FROM placed),
leveled AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER before, 0) * 2) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT arg_min(level, {{'s': source_size / weight, 'p': place}}) AS level FROM leveled WHERE source_size * 2::DOUBLE >= level * weight),
targets AS (SELECT w.source, w.source_size, least(w.source_size * 2::DOUBLE, coalesce(f.level, 'inf'::DOUBLE) * w.weight) AS target FROM weighed w, final f),
classes AS (SELECT source, odds, sum(size)::BIGINT AS words FROM narrow GROUP BY ALL),
scaled AS (
    SELECT c.source, c.odds, t.source_size, t.target,
        (t.target - coalesce(sum(c.words) OVER (PARTITION BY c.source ORDER BY c.odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2::DOUBLE)
        / nullif(sum(c.odds * c.words) OVER (PARTITION BY c.source ORDER BY c.odds DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS scale
    FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
copies AS (
    SELECT *, least(2::DOUBLE, coalesce(max(CASE WHEN scale * odds <= 2 THEN {{'o': odds, 's': scale}} END) OVER (PARTITION BY source)['s'], 'inf'::DOUBLE) * odds) AS c FROM scaled),
plan AS (SELECT source, odds, source_size, target, CASE WHEN abs(c - round(c)) < 1e-9 THEN round(c) ELSE round(c, 9) END AS expected FROM copies),
drawn AS (
    SELECT n.*, p.source_size, p.target, floor(p.expected)::BIGINT AS certain, p.expected - floor(p.expected) AS p,
        (('0x' || left(md5('7:' || coalesce(n.doc_id::VARCHAR, 'null')), 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496::DOUBLE AS u
    FROM narrow n JOIN plan p ON n.source IS NOT DISTINCT FROM p.source AND n.odds = p.odds),
keyed AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS k FROM drawn),
ranked AS (SELECT *, k / (1 + k) AS rank, target - sum(size * certain) OVER (PARTITION BY source) AS missing FROM keyed),
summed AS (
    SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS FIRST, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
        sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source) AS most
    FROM ranked),
fitted AS (SELECT *, rank IS NOT NULL AND upto <= missing AS fits FROM summed),
gapped AS (SELECT *, missing - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM fitted),
closing AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN rank IS NOT NULL AND NOT fits AND most > missing AND abs(size - gap) < gap THEN abs(size - gap) END NULLS LAST, rank, doc_id) AS place
    FROM gapped),
taken AS (SELECT *, certain + CASE WHEN fits OR (place = 1 AND rank IS NOT NULL AND NOT fits AND most > missing AND abs(size - gap) < gap) THEN 1 ELSE 0 END AS copies FROM closing)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM taken"""

# Every text is split into its tokens; the pieces are put together from the list.
MIDDLE_SQL = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
draws AS (SELECT *, len(u)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS d FROM t),
cuts AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain'
            WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM draws),
parts AS (SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts"""

def _moves() -> str:
    """What a turn may become after each state (0 nothing yet, 1 system, 2 user, 3 assistant): up to two insertions, then the
    turn deleted (D), kept with the role that fits (K) or given the other (R)."""
    following = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    rows = []
    for state in range(4):
        after, letters, added = state, "", []
        for _ in range(3):
            target, role = following[after]
            lists = "[" + ", ".join(f"'{r}:'" for r in added) + "]::VARCHAR[]"
            cost = 3 * len(added)
            rows.append(f"({state}, '{letters}D', 'D', NULL, NULL, {after}, {cost + 4}, {lists})")
            rows.append(f"({state}, '{letters}K', 'K', '{role[0]}', NULL, {target}, {cost}, {lists})")
            if after == 0:
                rows.append(f"({state}, '{letters}K', 'K', 's', NULL, 1, {cost}, {lists})")
            rows.append(f"({state}, '{letters}R', 'R', NULL, '{role}', {target}, {cost + 3}, {lists})")
            letters, added, after = letters + "I", [*added, role], target
    return ", ".join(rows)


# CRC-32 is put together from its polynomial; the least (cost, audit) per state goes from turn to turn.
REPAIR_SQL = rf"""
WITH RECURSIVE polynomial AS (
    SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
filled AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
kinds AS (
    SELECT filled.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(key, lambda c: ascii(c)::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 20 AS kind FROM filled, polynomial),
copied AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM copied),
turns AS (
    SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'sound' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
    FROM numbered),
moves AS (SELECT * FROM (VALUES {_moves()}) AS m(q, letters, edit, needed, given, target, price, added)),
paths AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, q, best['cost'], best['audit'], best['lines'] FROM (
        SELECT p.conv_id, p.i + 1 AS i, m.target AS q, min({{
            'cost': p.cost + m.price + CASE WHEN m.edit <> 'D' AND t.fault = 'truncated' THEN 3 ELSE 0 END, 'audit': p.audit || m.letters,
            'lines': p.lines || m.added || CASE m.edit WHEN 'D' THEN []::VARCHAR[] ELSE [coalesce(m.given, t.role) || ':' || t.text] END}}) AS best
        FROM paths p JOIN turns t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.i = p.i + 1
        JOIN moves m ON m.q = p.q AND (m.needed IS NULL OR m.needed = t.initial) AND (m.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
        GROUP BY ALL)),
counts AS (
    SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(i) AS n
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
ended AS (
    SELECT p.conv_id, min({{'cost': p.cost + e.price, 'audit': p.audit || e.letters, 'lines': p.lines || e.added}}) AS best
    FROM paths p JOIN counts c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n
    JOIN (VALUES (0, '', 0, []::VARCHAR[]), (1, 'II', 6, ['user:', 'assistant:']), (2, 'I', 3, ['assistant:']), (3, '', 0, []::VARCHAR[])) AS e(q, letters, price, added) ON e.q = p.q
    GROUP BY p.conv_id)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, best['cost']::BIGINT AS cost, best['audit'] AS audit, sha256(array_to_string(best['lines'], chr(10))) AS repaired_sha256
FROM counts c JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

SQL: dict[str, str] = {
    "op1_license_digests": _license_sql(),
    "op2_repetition_coverage": _quality_sql(),
    "op4_dictionary_warc": WARC_SQL,
    "op6_url_rules": _url_sql(),
    "op8_pareto_mix": MIX_SQL,
    "op11_chunk_memoization": MIDDLE_SQL,
    "op12_prefix_doubling": REPAIR_SQL,
}
