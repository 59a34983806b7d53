"""Check SQL of the operators that SQL can express."""

from __future__ import annotations

from tallyhire.llm import chat, rules


def _base32() -> str:
    """Every five hexadecimal digits of the digest ``h`` are four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    out = []
    for k in range(8):
        digits = f"CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT)"
        out += [f"substr({letters}, CAST(({digits} >> {shift}) & 31 AS INTEGER) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(out)


WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
    b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM d)
    SELECT page_id, payload_bytes, {_base32()} AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> best THEN best END AS refers_to FROM b"""


def _verdict() -> str:
    parts = []
    for rule in rules.THRESHOLDS:
        ratio = f"CASE WHEN {rule.denominator} > 0 THEN {rule.numerator}::DOUBLE / {rule.denominator} ELSE 0 END"
        if rule.least > float("-inf"):
            parts.append(f"{ratio} >= {rule.least}")
        if rule.most < float("inf"):
            parts.append(f"{ratio} <= {rule.most}")
    return " AND ".join(parts)


_SPACE = r"[\x20\x09-\x0D]"
_STOPS = ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
RULES = rf"""
    WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS s FROM documents),
    w AS (SELECT rid, doc_id, s, list_filter(regexp_split_to_array(s, '{_SPACE}+'), lambda x: x <> '') AS ws,
      list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
    starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
    wins AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(ws[i:i + 7], ' ')) AS n FROM starts),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM wins, (SELECT unnest(range(0, 8)) AS k) WHERE n > 1 GROUP BY rid),
    c AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
      CAST(len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS BIGINT) AS n_stop_words,
      CAST(len(list_filter(range(1, len(ws)), lambda j: ws[j] = ws[j + 1])) AS BIGINT) AS n_same_as_last,
      CAST(len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_shouted
      FROM w LEFT JOIN covered USING (rid)),
    f AS (SELECT *, n_words < {rules.LEAST_WORDS} OR 100 * n_repeat_words > {rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM c)
    SELECT *, NOT base_failed AND {_verdict()} AS kept FROM f"""


def _escaped(column: str) -> str:
    return rf"regexp_replace({column}, '<(\\*)\|', '<\\\1|', 'g')"


_TEXT = f"{chat.END}{chat.START}assistant ok"
_FRAME = len(chat.START) + len(chat.SEPARATOR) + len(chat.END)
CHAT = f"""
    WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS s FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{_TEXT}' UNION ALL SELECT -1, 1, '{chat.LEARNED_ROLE}', '{_TEXT}'),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || s || chr(10), '' ORDER BY turn, role, s) AS said,
      coalesce(string_agg(CASE WHEN role = '{chat.LEARNED_ROLE}' THEN s END, '' ORDER BY turn, role, s), '') AS loss,
      CAST(sum({_FRAME} + length({_escaped("role")}) + length({_escaped("s")})) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
      formatted_chars FROM g"""
