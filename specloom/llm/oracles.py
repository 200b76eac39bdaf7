"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, quality_rules


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def quality_rules_sql() -> str:
    stop = ", ".join(map(_quoted, quality_rules.STOP_WORDS))
    tests = [f"({r.ratio.replace('m.', '')}) {op} {b}::DOUBLE" for r in quality_rules.RULES for op, b in ((">=", r.low), ("<=", r.high)) if b is not None]
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
    win AS (SELECT doc_id, i, w[i : i + 2] AS win FROM w, unnest(range(1, len(w) - 1)) u(i)),
    dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win),
    hit AS (SELECT DISTINCT doc_id, i + k AS p FROM dup, unnest([0, 1, 2]) v(k) WHERE n > 1),
    rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM hit GROUP BY doc_id),
    m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
                 len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
                 len(list_filter(w, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouts
          FROM w LEFT JOIN rep USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed,
           NOT {failed} AND {" AND ".join(tests)} AS kept FROM m"""


CHAT = r"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    o AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                 coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
                 sum(length(replace(replace(role || text, '\', '\s'), '<', '\l')) + length('<turn></role>') + 1 + length('</turn>') + 1)::BIGINT AS formatted_chars
          FROM r GROUP BY conv_id)
    SELECT conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM o"""


def licenses_sql() -> str:
    known, parts = licenses.identifiers()
    cases = " ".join(f"WHEN {_quoted(s)} THEN {_quoted(k)}" for s, k in known.items())
    steps, names, kinds = [], [], []
    for k, (name, kind, ids) in enumerate(licenses.RULES):
        key = _quoted("|" + "|".join(parts[i] for i in ids) + "|")
        steps.append(f"r{k + 1} AS (SELECT *, contains(s{k}, {key}) AS h{k}, replace(s{k}, {key}, '||') AS s{k + 1} FROM r{k})")
        names.append(f"CASE WHEN h{k} THEN {_quoted(name)} END")
        kinds.append(f"CASE WHEN h{k} THEN {_quoted(kind)} END")
    firsts = lambda xs: f"array_to_string(list_filter([{', '.join(xs)}], lambda x, i: x IS NOT NULL AND list_position([{', '.join(xs)}], x) = i), ',')"
    return rf"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '([.;:!?])[ \t\x0B\f\r]+', '\1' || chr(10), 'g') AS t FROM documents),
    s AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\x0B\f\r]')) AS s FROM d),
    i AS (SELECT doc_id, s, list_transform(s, lambda x: CASE lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))) {cases} ELSE '' END) AS ids FROM s),
    r0 AS (SELECT doc_id, len(s)::BIGINT AS n_sentences, len(list_filter(ids, lambda x: x <> ''))::BIGINT AS n_known, '|' || array_to_string(ids, '|') || '|' AS s0 FROM i),
    {", ".join(steps)}
    SELECT doc_id, n_sentences, n_known, {firsts(names)} AS licences, {firsts(kinds)} AS kinds FROM r{len(steps)}"""


MIXING = rf"""
    WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, coalesce(text, '') AS t FROM documents),
    z AS (SELECT doc_id, skey, t, len(regexp_extract_all(t, '[^ \t-\r]+'))::BIGINT AS size FROM d),
    k AS (SELECT doc_id, skey, size, -ln((('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null:' || md5(t)))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496)
                 / greatest(0.1::DOUBLE, 1 - (length(t) - length(translate(t, '#*$%&|<>!', ''))) / greatest(size, 1)) AS key FROM z),
    s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM k GROUP BY skey),
    w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY skey) - 1) % 3) + 1]::DOUBLE AS weight, 2::DOUBLE * source_size AS most, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
    l AS (SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY most / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    g AS (SELECT skey, source_size, CASE WHEN most <= level * weight THEN most ELSE max(CASE WHEN most > level * weight THEN level END) OVER () * weight END AS target FROM l),
    p AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS epochs,
                 coalesce(sum(size) OVER (PARTITION BY skey ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN g USING (skey))
    SELECT doc_id, size, source_size, target, ((epochs + CASE WHEN size > 0 AND 2 * before + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM p"""


ORACLES = {"op2_mixing": MIXING, "op3_licenses": licenses_sql(), "op6_chat": CHAT, "op10_quality_rules": quality_rules_sql()}
