"""DuckDB SQL oracles: the same rules stated in SQL over the raw tables.

DuckDB's regex engine (RE2) has no look-around, so rules that use it in
Spark are restated: look-behind/ahead become captured groups, the sentence
split marks break points with chr(1) (twice, for overlapping breaks), and
noun-phrase chunking runs one regex over ``token__TAG`` text (RE2 does not
recurse, so this is safe there). Constants come from the same fixed tables
as the Spark code.
"""

from __future__ import annotations

from collections import defaultdict

from kbspark.functions import tagging as G
from kbspark.functions import text as T
from kbspark.functions.frames import unit_keys
from kbspark.operators import graph as GR
from kbspark.operators import pages as P
from kbspark.operators import retrieval as R
from kbspark.sources import wordlists as W

# ----------------------------------------------------------------- literals


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def str_map(d: dict) -> str:
    items = sorted(d.items())
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in items) + "}"


def list_map(d: dict) -> str:
    items = sorted(d.items())
    return "MAP {" + ", ".join(f"{lit(k)}: {str_list(sorted(v))}" for k, v in items) + "}"


def let(expr: str, var: str, body: str) -> str:
    """Bind ``expr`` once to ``var`` inside ``body``."""
    return f"(list_transform([{expr}], lambda {var}: {body}))[1]"


STOP = str_list(W.STOPWORDS)
LEX = str_map(G.LEXICON_TAGS)
NOUN_LEMMAS = str_map({f: l for (f, p), l in W.LEMMAS.items() if p == "n"})
ALL_LEMMAS = str_map({f"{f}__{p}": l for (f, p), l in W.LEMMAS.items()})


def _frame_keys() -> dict:
    acc = defaultdict(set)
    for unit, frame in W.LEXICAL_UNITS:
        for k in unit_keys(unit):
            acc[k].add(frame)
    return acc


FRAME_MAP = list_map(_frame_keys())
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"

# ----------------------------------------------------------------- text rules


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sanitize(x: str) -> str:
    s1 = rf"""regexp_replace({x}, '\s+([.,:)\]!''";])', '\1', 'g')"""
    s2 = rf"""regexp_replace({s1}, '([(\[\"''\\/])\s+', '\1', 'g')"""
    s3 = strip(rf"regexp_replace({s2}, '\s{{2,}}', ' ', 'g')")
    return let(s3, "sv", "CASE WHEN starts_with(sv, '<') AND ends_with(sv, '>') THEN '`' || sv || '`' ELSE sv END")


def clean_lines(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({x}, '{LINE_BREAK}'), lambda ln: {sanitize('ln')}), "
            f"lambda ln: ln <> '')")


def strip_md(x: str) -> str:
    a = rf"regexp_replace({x}, '\[(.+?)\]\([h/#].+?\)', '\1', 'g')"
    b = rf"regexp_replace({a}, '\*{{2,}}|\+\s|`<|`>', ' ', 'g')"
    return strip(rf"regexp_replace({b}, '\s{{2,}}', ' ', 'g')")


def sentences(x: str) -> str:
    """Break marks where a letter + end mark (+ blanks) meets a capital;
    a piece keeps only its last line (a match cannot cross a line break
    except in the blanks after the end mark); trimmed, >= 4 chars."""
    mark = rf"regexp_replace({{}}, '([A-Za-z][!.?;:]\s*)([A-Z])', '\1' || chr(1) || '\2', 'g')"
    marked = mark.format(mark.format(x))
    last_line = rf"regexp_extract(regexp_replace(p, '\s+$', ''), '[^\n]*$')"
    return (f"list_filter(list_transform(string_split({marked}, chr(1)), lambda p: {strip(last_line)}), "
            f"lambda s: length(s) >= 4)")


def line_sentences(x: str) -> str:
    """T1 line by line."""
    return f"flatten(list_transform(string_split_regex({x}, '{LINE_BREAK}'), lambda ln: {sentences('ln')}))"


def tokens(x: str) -> str:
    return (rf"list_filter(string_split_regex({strip(rf'''regexp_replace({x}, '[^\x00-\x7F]', '', 'g')''')}, '\s+'), "
            "lambda t: t <> '')")


def bare(t: str) -> str:
    return rf"lower(regexp_replace({t}, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))"


def rule_tag(t: str, i: str) -> str:
    b = "bk"
    parts = [f"WHEN {t} IN ({', '.join(lit(x) for x in G.BRACKET_TAGS)}) THEN {t}",
             f"WHEN {b} = '' THEN (CASE WHEN regexp_matches({t}, '^[.!?]+$') THEN '.' WHEN {t} = ',' THEN ',' "
             f"WHEN regexp_matches({t}, '^[:;]+$') THEN ':' ELSE 'SYM' END)",
             f"WHEN regexp_matches({b}, {lit(G.NUMBER_PATTERN)}) THEN 'CD'",
             f"WHEN regexp_matches({b}, '[0-9]') THEN 'NN'",
             f"WHEN {i} > 1 AND regexp_matches({t}, '^[A-Z]') THEN 'NNP'"]
    for pat, n, tag in G.SUFFIX_RULES:
        parts.append(f"WHEN length({b}) >= {n} AND regexp_matches({b}, {lit(pat)}) THEN '{tag}'")
    pat, not_pat, n, tag = G.PLURAL_RULE
    parts.append(f"WHEN length({b}) >= {n} AND regexp_matches({b}, {lit(pat)}) "
                 f"AND NOT regexp_matches({b}, {lit(not_pat)}) THEN '{tag}'")
    return let(bare(t), b, "CASE " + " ".join(parts) + " ELSE 'NN' END")


def tag_expr(t: str, i: str) -> str:
    return (f"CASE WHEN {t} IN ({', '.join(lit(x) for x in G.BRACKET_TAGS)}) THEN {t} "
            f"ELSE coalesce({LEX}[lower({t})], {LEX}[{bare(t)}], {rule_tag(t, i)}) END")


def tag_sentence(x: str) -> str:
    """T3 + T4: list of {token, pos} structs."""
    return f"list_transform({tokens(x)}, lambda tk, ti: {{'token': tk, 'pos': {tag_expr('tk', 'ti')}}})"


def encode(toks: str) -> str:
    return f"array_to_string(list_transform({toks}, lambda z: z.token || '__' || z.pos), ' ')"


def wordnet(p: str) -> str:
    return (f"CASE substr({p}, 1, 1) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'N' THEN 'n' "
            f"WHEN 'R' THEN 'r' ELSE '' END")


def normalize(x: str, lemmas: str | None = NOUN_LEMMAS, ignore_num: bool = False) -> str:
    """T8."""
    t0 = rf"regexp_replace({x}, '([A-Ze])s$', '\1')"
    t1 = rf"regexp_replace({t0}, '([A-Za-z])ies$', '\1y')"
    cls = r"[^A-Za-z.\s]" if ignore_num else r"[^A-Za-z0-9.\s]"
    t2 = rf"regexp_replace({t1}, '{cls}', ' ', 'g')"
    t3 = f"lower({strip(rf'''regexp_replace({t2}, '\s+', ' ', 'g')''')})"
    if lemmas is None:
        body = (rf"CASE WHEN regexp_extract(nt, '\s(\w+)$', 1) = '' THEN regexp_replace(nt, '\s+', '', 'g') "
                "ELSE nt END")
    else:
        body = let(rf"regexp_extract(nt, '\s(\w+)$', 1)", "rw",
                   rf"CASE WHEN rw = '' THEN regexp_replace(coalesce({lemmas}[nt], nt), '\s+', '', 'g') "
                   rf"ELSE regexp_replace(replace(nt, rw, coalesce({lemmas}[rw], rw)), '\s+', ' ', 'g') END")
    return let(t3, "nt", body)


CA = r"(?:\S+__JJR \S+__VB[A-Z]* |(?:\S+__RB )?\S+__JJ )"
EN = rf"(?:{CA}(?:(?:\S+__CC )?{CA})*)?(?:\S+__(?:NN[A-Z]*|FW) )+"

NP = rf"(?:\S+__DT )?(?:\S+__CC )?(?:\S+__CC \S+__CD )*{EN}(?:(?:\S+__CC )?{EN})*"


def valid_entities(leaves: str) -> str:
    """T9."""
    kept = f"list_filter({leaves}, lambda x: NOT regexp_matches(x, {lit(T.LINK_PATTERN)}))"
    junk = f"regexp_replace(x, {lit(T.JUNK_PATTERN)}, '', 'g')"
    cleaned = f"list_transform({kept}, lambda x: {strip(junk)})"
    cleaned = f"list_filter({cleaned}, lambda y: length(y) BETWEEN 2 AND 25)"
    pieces = f"list_transform(string_split_regex(array_to_string({cleaned}, ' '), {lit(T.PUNCT_SPLIT_PATTERN)}), lambda pc: {strip('pc')})"
    good = (rf"list_filter({pieces}, lambda x: x <> '' AND length(x) BETWEEN 2 AND 100 AND "
            rf"length(regexp_replace(x, '[A-Za-z.\s]', '', 'g')) / length(x) < 0.5)")
    return rf"list_transform({good}, lambda x: regexp_replace(x, '^[. ]+|[. ]+$', '', 'g'))"


def entities(enc: str) -> str:
    """E1 + E3 over encoded ``tok__TAG`` text: sorted distinct entities."""
    matches = f"regexp_extract_all({enc} || ' ', {lit(EN)})"
    leaves = rf"list_transform(string_split({strip('m')}, ' '), lambda lf: regexp_replace(lf, '__[^_]*$', ''))"
    per = f"list_transform({matches}, lambda m: list_transform({valid_entities(leaves)}, lambda e: {normalize('e')}))"
    return f"list_sort(list_distinct(list_filter(flatten({per}), lambda e: e <> '')))"


def frame_candidates(toks: str) -> str:
    """F1 over a list of {token, pos}."""
    return (f"list_filter(list_transform({toks}, lambda z: {{'word': lower(z.token), 'wn': {wordnet('z.pos')}}}), "
            f"lambda c: length(c.word) >= 2 AND NOT list_contains({STOP}, c.word))")


def frame_key() -> str:
    """F3 of a candidate c."""
    lemma = f"coalesce({ALL_LEMMAS}[c.word || '__' || c.wn], c.word)"
    use = let(lemma, "lm", f"CASE WHEN list_contains({STOP}, lm) THEN c.word ELSE lm END")
    return f"replace({normalize(use, None, True)}, '.', '') || '__' || c.wn"


def frames(toks: str) -> str:
    """F1-F6 over a list of {token, pos}."""
    cands = frame_candidates(toks)
    own = (f"list_filter(list_transform(list_filter(cs, lambda c: c.wn = ''), lambda c: "
           f"{let(normalize('c.word', None, True), 'nw', 'CASE WHEN length(nw) > 1 THEN nw END')}), "
           f"lambda x: x IS NOT NULL)")
    looked = (f"flatten(list_transform(list_filter(cs, lambda c: c.wn <> ''), "
              f"lambda c: coalesce({FRAME_MAP}[{frame_key()}], []::VARCHAR[])))")
    return let(cands, "cs", f"list_sort(list_distinct({own} || {looked}))")


# ----------------------------------------------------------------- simple queries
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

DOC_LINES = f"""
doc_lines AS (
  SELECT d.doc_id, u.line, u.i - 1 AS line_no
  FROM (SELECT doc_id, {clean_lines('text')} AS content FROM documents) d,
       unnest(d.content) WITH ORDINALITY AS u(line, i))"""

DOC_SENTS = DOC_LINES + f""",
doc_sents AS (
  SELECT l.doc_id, l.line_no, u.s AS sentence, u.j - 1 AS sent_idx
  FROM doc_lines l, unnest({sentences('l.line')}) WITH ORDINALITY AS u(s, j))"""

USER_SENTS = f"""
user_sents AS (
  SELECT c.conv_id, c.turn, concat_ws('-', c.conv_id, c.turn) AS q_id, c.text AS question,
         u.s AS sentence, u.j - 1 AS sent_idx
  FROM conversations c, unnest({line_sentences(f"trim(c.text, {lit(T.QUESTION_TRIM)})")}) WITH ORDINALITY AS u(s, j)
  WHERE c.role = 'user' AND c.text IS NOT NULL)"""


def simple() -> dict[str, str]:
    q = {}
    q["s1_scan_documents"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
    q["s2_row_counts"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)
    q["c1_canonical_url"] = "SELECT page_id, split_part(url, '?', 1) AS canonical_id FROM pages"
    links = page_links_sql()
    q["c2_first_page_per_url"] = f"""
WITH {links}
SELECT canonical_id, min(page_id) AS page_id FROM (
  SELECT split_part(url, '?', 1) AS canonical_id, page_id FROM pages UNION ALL SELECT link_id, page_id FROM links) GROUP BY 1"""
    q["c3_out_links"] = f"""
WITH {links},
known AS (SELECT DISTINCT split_part(url, '?', 1) AS link_id FROM pages)
SELECT page_id, link_id, link_id NOT IN (SELECT link_id FROM known) AS follow FROM links"""
    inner = (r"array_to_string(list_filter(list_transform(string_split_regex({}, '<[^>]*>'), "
             r"lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> ''), ' ')")
    q["c4_title_h1"] = (rf"SELECT page_id, {inner.format(f'regexp_extract(html, {lit(P.TITLE_PATTERN)}, 1)')} AS title, "
                        rf"{strip(f'array_to_string(list_transform(regexp_extract_all(html, {lit(P.H1_PATTERN)}, 1), lambda h: {inner.format(chr(104))}), chr(32))')}"
                        r" AS h1 FROM pages")
    q["c12_product_key"] = (r"SELECT page_id, CASE WHEN regexp_extract(url, '/en/(.[^/]*)', 1) = '' THEN NULL "
                            r"ELSE regexp_extract(url, '/en/(.[^/]*)', 1) END AS product FROM pages")
    q["c9_clean_lines"] = f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM doc_lines"
    q["m1_heading_lines"] = (f"WITH {DOC_LINES} SELECT doc_id, line_no, "
                             r"length(regexp_extract(line, '(#+)\s(.*)', 1)) AS level, "
                             f"{strip_md(r'''regexp_extract(line, '(#+)\s(.*)', 2)''')} AS heading "
                             r"FROM doc_lines WHERE regexp_matches(line, '(#+)\s')")
    q["t1_sentences"] = f"WITH {DOC_SENTS} SELECT doc_id, line_no, sent_idx, sentence FROM doc_sents"
    q["t4_tagged"] = (f"WITH {DOC_SENTS}, tg AS (SELECT *, {tag_sentence('sentence')} AS toks FROM doc_sents) "
                      f"SELECT doc_id, line_no, sent_idx, {encode('toks')} AS tagged, "
                      f"array_to_string(list_transform(toks, lambda z: {wordnet('z.pos')}), ',') AS wn FROM tg")
    q["e3_entities"] = (f"WITH {DOC_SENTS}, tg AS (SELECT *, {encode(tag_sentence('sentence'))} AS enc FROM doc_sents) "
                        f"SELECT doc_id, line_no, sent_idx, unnest({entities('enc')}) AS entity FROM tg")
    q["e2_np_vp_segments"] = f"""
WITH {DOC_SENTS},
tg AS (SELECT doc_id, line_no, sent_idx, {encode(tag_sentence('sentence'))} AS enc FROM doc_sents),
piece AS (
  SELECT doc_id, line_no, sent_idx, u.k, len(string_split(u.p, ' ')) - 1 AS len
  FROM tg, unnest(string_split(regexp_replace(enc || ' ', {lit(NP)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))) WITH ORDINALITY AS u(p, k)
  WHERE enc <> '' AND u.p <> '')
SELECT doc_id, line_no, sent_idx, row_number() OVER w - 1 AS i, CASE WHEN k % 2 = 0 THEN 'NP' ELSE 'VP' END AS label,
       1 + sum(len) OVER w - len AS start, len
FROM piece WINDOW w AS (PARTITION BY doc_id, line_no, sent_idx ORDER BY k)"""
    q["t8_normalize_part_names"] = f"SELECT p_partkey, {normalize('p_name')} AS normalized FROM part"
    words = r"list_filter(string_split_regex(regexp_replace(p_name, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')"
    q["t10_part_name_ngrams"] = f"""
WITH w AS (SELECT p_partkey, {words} AS ws FROM part),
g AS (SELECT p_partkey, ws, n.n, s.i FROM w, unnest(range(len(ws) - 1, 0, -1)) AS n(n),
      unnest(range(1, len(ws) - n.n + 2)) AS s(i) WHERE len(ws) > 1)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, i) - 1) AS pos,
       array_to_string(ws[i:i + n - 1], ' ') AS gram, n FROM g"""
    q["t13_important_tokens"] = (
        rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(text, '\s+'), "
        rf"lambda w: w <> '' AND NOT list_contains({STOP}, w)))), ' ') AS tokens FROM conversations WHERE role = 'user'")
    q["t16_question_trim"] = (f"SELECT conv_id, turn, trim(text, {lit(T.QUESTION_TRIM)}) AS trimmed "
                              f"FROM conversations WHERE role = 'user'")
    q["t17_alnum_length"] = r"SELECT doc_id, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS alnum_len FROM documents"
    q["t15_question_score"] = f"""
WITH {USER_SENTS},
tg AS (SELECT conv_id, turn, sent_idx, sentence, list_transform({tag_sentence('sentence')}, lambda z: z.pos) AS tags
       FROM user_sents),
sc AS (SELECT *, len(tags) AS n,
       list_position(list_transform(tags, lambda p: starts_with(p, 'W')), true) AS fw,
       list_position(list_transform(tags, lambda p: starts_with(p, 'M')), true) AS fm,
       CASE WHEN contains(sentence, '?') THEN 1 ELSE 0 END AS q FROM tg)
SELECT conv_id, turn, sent_idx, round(((n + 1) * q + CASE WHEN fw > 0 THEN n - fw + 1 ELSE 0 END
       + CASE WHEN fm > 0 THEN n - fm + 1 ELSE 0 END)::DOUBLE / (3.0 * (n + 1)), 9) AS score FROM sc"""
    q["t15_question_marks"] = q["t15_question_score"].replace("c.text,", "(translate(c.text, '.', '?') || ' Or'),", 1).replace(
        "trim(c.text,", "trim(translate(c.text, '.', '?') || ' Or',")
    q["c10_clean_items"] = f"""
WITH heads AS ({q["c4_title_h1"]}),
items AS (SELECT p.page_id, split_part(p.url, '?', 1) AS doc_id, h.title, h.h1, regexp_replace(p.html, '<[^>]*>', chr(10), 'g') AS content
          FROM pages p JOIN heads h USING (page_id) WHERE h.title <> ''),
firsts AS (SELECT * FROM items WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_id) = 1),
cleaned AS (SELECT doc_id, page_id, {sanitize('title')} AS title, {sanitize('h1')} AS heading, {clean_lines('content')} AS lines FROM firsts)
SELECT doc_id, page_id, title, heading, array_to_string(lines, chr(10)) AS content FROM cleaned
WHERE (length(title) > 0 OR length(heading) > 0) AND len(lines) > 0"""
    said = (r"array_to_string(list_transform(list_filter(string_split({}, ' '), lambda x: x <> ''), "
            r"lambda x: regexp_replace(x, '__[^_]*$', '')), ' ')")
    phrase = (f"list_reduce([{said.format('p')}] || list_transform(regexp_extract_all(p, {lit(EN)}), lambda m: {said.format('m')}), "
              f"lambda acc, e: replace(acc, e, {lit(G.ENTITY_PLACEHOLDER)}))")
    joined = strip(f"array_to_string(list_filter(list_transform(pieces, lambda p, k: CASE WHEN k % 2 = 0 THEN {phrase} "
                   f"ELSE {said.format('p')} END), lambda x: x <> ''), ' ')")
    unbracketed = strip(f"regexp_replace({joined}, {lit(T.BRACKET_TAG_PATTERN)}, ' ', 'g')")
    merged = strip(rf"regexp_replace({unbracketed}, '({G.ENTITY_PLACEHOLDER})(\s+{G.ENTITY_PLACEHOLDER})+', '\1', 'g')")
    q["t12_sentence_template"] = f"""
WITH {DOC_SENTS},
tg AS (SELECT doc_id, line_no, sent_idx, {encode(tag_sentence('sentence'))} AS enc FROM doc_sents),
cut AS (SELECT doc_id, line_no, sent_idx, string_split(regexp_replace(enc || ' ', {lit(NP)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS pieces FROM tg)
SELECT doc_id, line_no, sent_idx, {let(merged, 'tv', "CASE WHEN tv = '' THEN NULL WHEN regexp_matches(tv, '[!;:.]$') THEN tv ELSE tv || '.' END")} AS template FROM cut"""
    q["k14_progress"] = """
WITH e AS (
  SELECT event_type AS job, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n,
         count(*) OVER (PARTITION BY event_type) AS total, min(ts) OVER (PARTITION BY event_type) AS start,
         coalesce(lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id),
                  min(ts) OVER (PARTITION BY event_type)) AS prev_ts
  FROM events),
r AS (
  SELECT *, (epoch_us(prev_ts) - epoch_us(start)) / 1e6 AS pd, (epoch_us(ts) - epoch_us(start)) / 1e6 AS cd FROM e),
r2 AS (
  SELECT *, 0.05 * (CASE WHEN n = 1 THEN 0.0 WHEN pd > 0 THEN (n - 1) / pd END)
          + 0.95 * (CASE WHEN cd > 0 THEN n / cd END) AS rate FROM r)
SELECT job, n, total, round(CAST(n * 100 AS DECIMAL(38,10)) / CAST(total AS DECIMAL(38,10)), 2)::DOUBLE AS percent,
       CAST(CASE WHEN rate > 0 THEN floor((total - n) / rate) END AS BIGINT) AS eta FROM r2"""
    return q


def page_links_sql() -> str:
    """CTEs hrefs and links(page_id, link_id): resolved link targets."""
    scheme = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)"
    host = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    return rf"""
hrefs AS (
  SELECT page_id, url, regexp_replace(unnest(regexp_extract_all(html, {lit(P.HREF_PATTERN)}, 1)), '^["'']|["'']$', '', 'g') AS href
  FROM pages),
based AS (
  SELECT *, regexp_replace(url, '#.*$', '') AS base, regexp_replace(regexp_replace(url, '#.*$', ''), '\?.*$', '') AS path_base,
         {scheme} || '://' || {host} AS site FROM hrefs),
foldered AS (
  SELECT *, regexp_replace(regexp_replace(path_base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[^/]*$', '') AS folder FROM based),
targets AS (
  SELECT *, regexp_extract(CASE WHEN folder = '' THEN '/' ELSE folder END || href, '^[^?#]*') AS tpath,
         regexp_replace(CASE WHEN folder = '' THEN '/' ELSE folder END || href, '^[^?#]*', '') AS rest FROM foldered),
folded AS (
  SELECT *, list_reduce(string_split(tpath, '/')[2:], lambda acc, p: CASE WHEN p = '..' THEN acc[1:greatest(len(acc) - 1, 0)]
         WHEN p = '.' THEN acc ELSE list_append(acc, p) END, []::VARCHAR[]) AS parts FROM targets),
links AS (
  SELECT DISTINCT page_id, split_part(link, '?', 1) AS link_id FROM (
    SELECT page_id, CASE
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
      WHEN starts_with(href, '//') THEN {scheme} || ':' || href
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      WHEN href = '' THEN base
      WHEN starts_with(href, '/') THEN site || href
      WHEN starts_with(href, '?') THEN path_base || href
      WHEN starts_with(href, '#') THEN base || href
      ELSE site || '/' || array_to_string(parts, '/') || CASE WHEN regexp_matches(tpath, '/\.\.?$') AND len(parts) > 0
           THEN '/' ELSE '' END || rest END AS link FROM folded) WHERE link IS NOT NULL)"""


# ----------------------------------------------------------------- KB chain

KB_CTE = DOC_LINES.replace("doc_lines AS (", "doc_lines0 AS (") + f""",
dtitle AS (SELECT doc_id, ({sentences('line')})[1] AS title FROM doc_lines0 WHERE line_no = 0),
docinfo AS (
  SELECT l.doc_id, d.source AS product, d.lang,
         CASE WHEN length(t.title) <= {P.TITLE_LENGTH} THEN t.title ELSE 'document ' || CAST(l.doc_id AS VARCHAR) END AS page_heading,
         l.line_no AS i,
         length(regexp_extract(l.line, '(#+)\\s(.*)', 1)) AS lvl, l.line
  FROM doc_lines0 l JOIN documents d USING (doc_id) LEFT JOIN dtitle t USING (doc_id)),
info AS (
  SELECT *, CASE WHEN lvl > 0 THEN {strip_md(r"regexp_extract(line, '(#+)\s(.*)', 2)")} ELSE {strip_md('line')} END AS txt
  FROM docinfo),
state AS (
  SELECT *,
    coalesce(sum(CASE WHEN lvl > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec,
    {", ".join(f"last_value(CASE WHEN lvl = {k} THEN txt END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h{k}" for k in range(1, 8))}
  FROM info),
content AS (
  SELECT doc_id, sec AS section_idx,
         [product, lang] || list_filter([coalesce(h1, page_heading), h2, h3, h4, h5, h6, h7], lambda x: x IS NOT NULL) AS path,
         row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) - 1 AS line_no, txt AS line
  FROM state WHERE lvl = 0),
secs AS (SELECT DISTINCT doc_id, section_idx, path FROM content),
ksents AS (
  SELECT c.doc_id, c.section_idx, c.path, c.line_no, u.s AS text, u.j - 1 AS sent_idx
  FROM content c, unnest({sentences('c.line')}) WITH ORDINALITY AS u(s, j)),
ktag AS (SELECT *, {tag_sentence('text')} AS toks FROM ksents),
kenc AS (SELECT *, {encode('toks')} AS sentence FROM ktag),
pref AS (SELECT s.doc_id, s.section_idx, u.k, s.path[1:u.k] AS hpath FROM secs s, unnest(range(1, len(s.path) + 1)) AS u(k)),
hfirst AS (SELECT *, row_number() OVER (PARTITION BY hpath ORDER BY doc_id, section_idx) AS rn FROM pref),
hid AS (SELECT hpath, k, 1 + row_number() OVER (ORDER BY doc_id, section_idx, k) AS heading_id FROM hfirst WHERE rn = 1),
kheadings AS (
  SELECT 1::BIGINT AS heading_id, 'ROOT' AS heading, 0::BIGINT AS parent_id, []::VARCHAR[] AS hpath
  UNION ALL
  SELECT c.heading_id, c.hpath[-1], coalesce(p.heading_id, 1), c.hpath FROM hid c LEFT JOIN hid p ON p.hpath = c.hpath[1:c.k - 1]),
sfirst AS (SELECT *, row_number() OVER (PARTITION BY sentence, path ORDER BY doc_id, section_idx, line_no, sent_idx) AS rn
           FROM kenc),
ksentences AS (
  SELECT row_number() OVER (ORDER BY f.doc_id, f.section_idx, f.line_no, f.sent_idx) AS sentence_id, f.sentence,
         h.heading_id, f.toks
  FROM sfirst f JOIN hid h ON h.hpath = f.path WHERE f.rn = 1),
klinks AS (SELECT DISTINCT s.sentence_id, u.entity FROM ksentences s, unnest({entities('s.sentence')}) AS u(entity)),
kentities AS (SELECT entity, row_number() OVER (ORDER BY min(sentence_id), entity) AS entity_id FROM klinks GROUP BY entity),
knorms AS (SELECT l.sentence_id, e.entity_id FROM klinks l JOIN kentities e USING (entity)),
kframes AS (SELECT DISTINCT u.frame, s.sentence_id FROM ksentences s, unnest({frames('s.toks')}) AS u(frame)),
kinfo AS (SELECT s.heading_id, h.heading, min(s.sentence_id) AS first_sentence_id, max(s.sentence_id) AS last_sentence_id
          FROM ksentences s JOIN kheadings h USING (heading_id) GROUP BY s.heading_id, h.heading)"""


#: Documents in two batches, even ids first, give the KB of that order.
TWO_BATCHES = KB_CTE.replace("ORDER BY doc_id,", "ORDER BY doc_id % 2, doc_id,").replace("ORDER BY f.doc_id,", "ORDER BY f.doc_id % 2, f.doc_id,")


def kb_queries() -> dict[str, str]:
    w = f"WITH {KB_CTE}"
    q = {}
    q["m4_sections"] = (f"{w} SELECT doc_id, section_idx, array_to_string(path, ' > ') AS path, count(*) AS n_lines "
                        f"FROM content GROUP BY doc_id, section_idx, path")
    q["k2_headings"] = (f"{w} SELECT heading_id, heading, parent_id, array_to_string(hpath, ' > ') AS path "
                        f"FROM kheadings")
    q["k6_sentences"] = f"{w} SELECT sentence_id, heading_id, sentence FROM ksentences"
    q["k4_entities"] = f"{w} SELECT entity_id, entity FROM kentities"
    q["k5_normalizations"] = f"{w} SELECT sentence_id, entity_id FROM knorms"
    q["k7_frame_index"] = f"{w} SELECT frame, sentence_id FROM kframes"
    q["f4_frames_by_table"] = q["k7_frame_index"]
    q["f5_frame_memo"] = f"""{w},
words AS (SELECT DISTINCT u.c AS c FROM ksentences s, unnest({frame_candidates('s.toks')}) AS u(c)),
fkeys AS (SELECT DISTINCT {frame_key()} AS key FROM words WHERE c.wn <> '')
SELECT key, array_to_string(list_sort(coalesce({FRAME_MAP}[key], []::VARCHAR[])), '|') AS frames FROM fkeys"""
    q["k9_heading_content"] = (f"{w} SELECT s.heading_id, h.heading, s.sentence_id, s.sentence "
                               f"FROM ksentences s JOIN kheadings h USING (heading_id)")
    q["k11_sentence_count"] = f"{w} SELECT count(*) AS n FROM ksentences"
    q["k15_heading_info"] = f"{w} SELECT heading_id, heading, first_sentence_id, last_sentence_id FROM kinfo"
    q["k8_hierarchy"] = f"""{w},
pairs AS (SELECT a.heading_id AS ancestor_id, d.heading_id AS descendant_id, len(d.hpath) - len(a.hpath) AS depth
          FROM kheadings d, unnest(range(0, len(d.hpath))) AS u(k) JOIN kheadings a ON a.hpath = d.hpath[1:u.k]
          WHERE len(d.hpath) > 0)
SELECT ancestor_id AS heading_id, descendant_id AS related_id, depth::INT AS idx FROM pairs
UNION ALL SELECT descendant_id, ancestor_id, (-depth)::INT FROM pairs
UNION ALL SELECT heading_id, heading_id, 0 FROM kheadings"""
    acr = ", ".join(f"({lit(a.lower())}, {lit(t.lower())})" for t, a in W.ACRONYMS)
    q["d1_acronym_expansion"] = f"""{w},
acr AS (SELECT entity, min(term) AS term FROM (VALUES {acr}) v(entity, term) GROUP BY entity)
SELECT e.entity_id, e.entity, coalesce(a.term, e.entity) AS expanded FROM kentities e LEFT JOIN acr a USING (entity)"""
    q["d2_entity_stoplist"] = (f"{w} SELECT entity_id, entity FROM kentities "
                               f"WHERE NOT list_contains({str_list(W.ENTITY_STOPWORDS)}, entity)")
    maxw = 2  # the forced phrases are the entities of two words
    words = (r"list_filter(list_transform(string_split(s.sentence, ' '), lambda x: "
             r"lower(regexp_replace(regexp_replace(x, '__[^_]*$', ''), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'))), "
             r"lambda x: x <> '')")
    q["d3_forced_entities"] = f"""{w},
ws AS (SELECT s.sentence_id, {words} AS w FROM ksentences s),
grams AS (SELECT DISTINCT sentence_id, array_to_string(w[i:i + k - 1], ' ') AS entity
          FROM ws, unnest(range(1, {maxw} + 1)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i))
SELECT sentence_id, entity FROM grams
WHERE entity IN (SELECT entity FROM kentities WHERE len(string_split(entity, ' ')) = {maxw})"""
    q["k3_upsert"] = f"""WITH {TWO_BATCHES}
SELECT 'heading' AS kind, heading_id AS id, parent_id AS ref, array_to_string(hpath, ' > ') AS text FROM kheadings
UNION ALL SELECT 'sentence', sentence_id, heading_id, sentence FROM ksentences
UNION ALL SELECT 'entity', entity_id, 0, entity FROM kentities
UNION ALL SELECT 'link', sentence_id, entity_id, '' FROM knorms
UNION ALL SELECT 'frame', sentence_id, 0, frame FROM kframes
UNION ALL SELECT 'first', heading_id, first_sentence_id, heading FROM kinfo
UNION ALL SELECT 'last', heading_id, last_sentence_id, heading FROM kinfo"""
    q["k4_by_tables"] = f"""{w}
SELECT 'sentence' AS kind, sentence_id AS id, heading_id AS ref, sentence AS text FROM ksentences
UNION ALL SELECT 'entity', entity_id, 0, entity FROM kentities
UNION ALL SELECT 'link', sentence_id, entity_id, '' FROM knorms
UNION ALL SELECT 'frame', sentence_id, 0, frame FROM kframes"""
    kb_tables = {"headings": "kheadings", "sentences": "ksentences", "entities": "kentities", "normalizations": "knorms",
                 "frame_index": "kframes", "heading_info": "kinfo"}
    q["s8_live_counts"] = f"WITH {TWO_BATCHES} " + " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, 2 AS number, count(*) AS n FROM {t}" for name, t in kb_tables.items())
    q["k12_ordered_entities"] = f"{w} SELECT row_number() OVER (ORDER BY entity) AS pos, entity_id, entity FROM kentities"
    q["k13_sentence_lookup"] = f"""{w},
req AS (SELECT heading_id AS req, u.i - 1 AS pos, u.id AS sentence_id FROM kinfo,
        unnest([last_sentence_id, first_sentence_id, first_sentence_id - 1]) WITH ORDINALITY AS u(id, i))
SELECT req, pos, sentence_id, array_to_string(list_transform(toks, lambda z: z.token), ' ') AS tokens,
       array_to_string(list_transform(toks, lambda z: z.pos), ' ') AS tags FROM req JOIN ksentences USING (sentence_id)"""
    return q


# ----------------------------------------------------------------- question chain
Q_CTE = f"""{USER_SENTS},
qtag AS (SELECT q_id, sent_idx, question, {tag_sentence('sentence')} AS toks FROM user_sents),
qan AS (SELECT q_id, sent_idx, question, {entities(encode('toks'))} AS q_entities, {frames('toks')} AS q_frames
        FROM qtag)"""


def weighted_distance(src: str, tgt: str) -> str:
    """Q3 dynamic program with list_reduce (rows over the target)."""
    n = f"length({tgt})"
    first = f"list_transform(range(0, {n} + 1), lambda j: j * {R.Z.INSERT_COST})"
    inner = (f"list_reduce(range(1, {n} + 1), lambda r, j: list_append(r, least(row[j + 1] + {R.Z.DELETE_COST}, "
             f"r[-1] + {R.Z.INSERT_COST}, row[j] + CASE WHEN ch = substr({tgt}, j, 1) THEN 0 ELSE "
             f"{R.Z.SUBSTITUTE_COST} END)), [row[1] + {R.Z.DELETE_COST}])")
    return (f"(list_reduce(list_transform(range(1, length({src}) + 1), lambda k: substr({src}, k, 1)), "
            f"lambda row, ch: {inner}, {first}))[-1]")


def question_queries() -> dict[str, str]:
    q = {}
    q["q1_question_analysis"] = (f"WITH {Q_CTE} SELECT q_id, sent_idx, array_to_string(q_entities, '|') AS entities, "
                                 f"array_to_string(q_frames, '|') AS frames FROM qan")
    q["q1_by_tables"] = q["q1_question_analysis"]
    q["f6_question_frames"] = f"WITH {Q_CTE} SELECT q_id, sent_idx, unnest(q_frames) AS frame FROM qan"
    seg = R.SEGMENTS
    cand = f"""WITH {KB_CTE}, {Q_CTE},
qents AS (SELECT q_id, sent_idx, unnest(q_entities) AS q_entity FROM qan),
lookups AS (
  SELECT q_id, sent_idx, q_entity, q_entity AS gram, {R.DIRECT_LEVEL} AS n FROM qents
  UNION ALL
  SELECT q_id, sent_idx, q_entity, array_to_string(ws[i:i + nn - 1], ' ') AS gram, nn AS n
  FROM (SELECT *, string_split(q_entity, ' ') AS ws FROM qents) x,
       unnest(range(len(ws) - 1, 0, -1)) AS a(nn), unnest(range(1, len(ws) - nn + 2)) AS b(i)
  WHERE len(ws) > 1),
grams AS (SELECT DISTINCT gram, length(gram) AS glen FROM lookups WHERE length(gram) BETWEEN 1 AND 50),
ents AS (SELECT entity_id, entity, length(entity) AS elen FROM kentities WHERE length(entity) <= 50),
ps AS (
  SELECT g.gram, e.entity_id, e.entity, e.elen, e.elen - g.glen AS dist FROM grams g JOIN ents e
    ON e.elen >= g.glen AND (starts_with(e.entity, g.gram) OR ends_with(e.entity, g.gram))),
eseg AS (
  SELECT e.*, s.i AS seg_i,
         substr(e.entity, s.i * (e.elen // {seg}) + greatest(s.i - ({seg} - e.elen % {seg}), 0) + 1,
                e.elen // {seg} + CASE WHEN s.i >= {seg} - e.elen % {seg} THEN 1 ELSE 0 END) AS seg
  FROM ents e, unnest(range(0, {seg})) AS s(i) WHERE e.elen >= {seg}),
gseg AS (
  SELECT DISTINCT g.gram, m.m AS elen, s.i AS seg_i,
         substr(g.gram, p.p, m.m // {seg} + CASE WHEN s.i >= {seg} - m.m % {seg} THEN 1 ELSE 0 END) AS seg
  FROM grams g, unnest(range(greatest(g.glen, {seg}), least(g.glen + {R.MAX_SHIFT}, 50) + 1)) AS m(m),
       unnest(range(0, {seg})) AS s(i),
       unnest(range(s.i * (m.m // {seg}) + greatest(s.i - ({seg} - m.m % {seg}), 0) + 1 - {R.MAX_SHIFT},
                    s.i * (m.m // {seg}) + greatest(s.i - ({seg} - m.m % {seg}), 0) + 1 + {R.MAX_SHIFT} + 1)) AS p(p)
  WHERE p.p >= 1 AND p.p + (m.m // {seg} + CASE WHEN s.i >= {seg} - m.m % {seg} THEN 1 ELSE 0 END) - 1 <= g.glen),
edit0 AS (
  SELECT DISTINCT gs.gram, e.entity_id, e.entity, e.elen FROM gseg gs JOIN eseg e USING (elen, seg_i, seg)
  UNION
  SELECT g.gram, e.entity_id, e.entity, e.elen FROM grams g JOIN ents e
    ON e.elen < {seg} AND g.glen < {seg} AND e.elen >= g.glen),
edit AS (
  SELECT gram, entity_id, entity, elen, {weighted_distance('entity', 'gram')} AS dist FROM edit0
  WHERE levenshtein(entity, gram) <= {R.MAX_SHIFT}),
cands AS (SELECT * FROM ps UNION SELECT * FROM edit WHERE dist < {R.Z.MAX_DISTANCE_EXCLUSIVE}),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY elen, dist, entity) AS rk FROM cands)
        WHERE rk <= {R.CANDIDATES_PER_TEXT})"""
    q["q4_entity_candidates"] = f"{cand} SELECT gram, entity_id, entity, elen::INT AS elen, dist::INT AS dist FROM top"
    division = f"""{cand},
matched AS (SELECT l.q_id, l.sent_idx, l.q_entity, t.entity_id, max(l.n) AS level
            FROM lookups l JOIN top t USING (gram) GROUP BY ALL),
ntok AS (SELECT q_id, sent_idx, list_max(list_transform(q_entities, lambda e: len(string_split(e, ' ')))) AS n_max
         FROM qan WHERE len(q_entities) > 0),
ne AS (SELECT q_id, sent_idx, q_entity, max(level) AS ne FROM matched GROUP BY ALL),
sh AS (SELECT m.q_id, m.sent_idx, m.q_entity, n.sentence_id, s.heading_id, max(m.level) AS lvl
       FROM matched m JOIN knorms n USING (entity_id) JOIN ksentences s USING (sentence_id) GROUP BY ALL),
best AS (SELECT q_id, sent_idx, heading_id, q_entity, max(lvl) AS best FROM sh GROUP BY ALL),
levels AS (SELECT t.q_id, t.sent_idx, l.level FROM ntok t, unnest(range(1, greatest(t.n_max, 1) + 1)) AS l(level)
           WHERE EXISTS (SELECT 1 FROM ne WHERE ne.q_id = t.q_id AND ne.sent_idx = t.sent_idx)),
need AS (SELECT l.q_id, l.sent_idx, l.level, count(*) AS k FROM levels l JOIN ne USING (q_id, sent_idx)
         WHERE ne.ne >= l.level GROUP BY ALL),
have AS (SELECT l.q_id, l.sent_idx, l.level, b.heading_id, count(*) AS k FROM levels l JOIN ne USING (q_id, sent_idx)
         JOIN best b ON b.q_id = l.q_id AND b.sent_idx = l.sent_idx AND b.q_entity = ne.q_entity
         WHERE ne.ne >= l.level AND b.best >= l.level GROUP BY ALL),
cand AS (SELECT h.* FROM have h JOIN need n USING (q_id, sent_idx, level) WHERE h.k = n.k AND n.k > 0),
cnt AS (SELECT q_id, sent_idx, level, count(*) AS nh FROM cand GROUP BY ALL),
chosen AS (SELECT l.q_id, l.sent_idx, coalesce(max(CASE WHEN c.nh >= {R.MIN_RESULT_HEADINGS} THEN l.level END), 1) AS level
           FROM levels l LEFT JOIN cnt c USING (q_id, sent_idx, level) GROUP BY ALL),
groups AS (SELECT c.q_id, c.sent_idx, c.heading_id, c.level FROM cand c JOIN chosen USING (q_id, sent_idx, level)),
hits AS (SELECT g.q_id, g.sent_idx, g.heading_id, s.sentence_id FROM groups g
         JOIN (SELECT q_id, sent_idx, heading_id, sentence_id, max(lvl) AS lvl FROM sh GROUP BY ALL) s
         USING (q_id, sent_idx, heading_id) WHERE s.lvl >= g.level)"""
    q["q8_division"] = f"{division} SELECT q_id, sent_idx, heading_id, level FROM groups"
    kept = f"""{division},
kept AS (SELECT g.q_id, g.sent_idx, g.heading_id FROM groups g JOIN qan a USING (q_id, sent_idx)
WHERE len(a.q_frames) = 0 OR EXISTS (
  SELECT 1 FROM hits h JOIN kframes f USING (sentence_id)
  WHERE h.q_id = g.q_id AND h.sent_idx = g.sent_idx AND h.heading_id = g.heading_id AND list_contains(a.q_frames, f.frame)))"""
    q["q9_frame_filter"] = f"{kept} SELECT * FROM kept"
    q.update(answer_queries(kept))
    return q


# ----------------------------------------------------------------- scores and answers

def lcs(a: str, b: str) -> str:
    """Longest common subsequence, row by row over the characters of ``a``."""
    inner = (f"list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, CASE WHEN ch = substr({b}, j, 1) "
             f"THEN row[j] + 1 ELSE greatest(row[j + 1], r[-1]) END), [0::BIGINT])")
    return (f"(list_reduce(string_split({a}, ''), lambda row, ch: {inner}, "
            f"list_transform(range(0, length({b}) + 1), lambda j: 0::BIGINT)))[-1]")


def percent(part: str, total: str) -> str:
    return f"round_even(100.0::DOUBLE * ((2 * ({part}))::DOUBLE / ({total})::DOUBLE), 0)"


def fuzzy_tokens(x: str) -> str:
    return (rf"list_sort(list_filter(string_split(lower(regexp_replace(regexp_replace({x}, '[^\x00-\x7F]', '', 'g'), "
            rf"'[^A-Za-z0-9_]', ' ', 'g')), ' '), lambda w: w <> ''))")


def important(x: str) -> str:
    """T13."""
    return (rf"array_to_string(list_sort(list_distinct(list_filter(string_split_regex({x}, '\s+'), "
            rf"lambda w: w <> '' AND NOT list_contains({STOP}, w)))), ' ')")


def rebuilt(toks: str) -> str:
    """T11 over a list of {token, pos}."""
    s = strip(f"array_to_string(list_transform({toks}, lambda z: z.token), ' ')")
    r = "sv"
    for tag, rep in (("LCB", " {"), ("RCB", "} "), ("LSB", " ["), ("RSB", "] "), ("LRB", " ("), ("RRB", ") ")):
        r = strip(rf"regexp_replace({r}, '\s*-{tag}-\s*', '{rep}', 'g')")
    body = f"CASE WHEN regexp_matches(sv, {lit(T.BRACKET_TAG_PATTERN)}) THEN {r} ELSE sv END"
    return let(let(s, "sv", body), "sw", "CASE WHEN regexp_matches(sw, '[!;:.]$') THEN sw ELSE sw || '.' END")


def answer_queries(kept: str) -> dict[str, str]:
    """Q10-Q16, S10 and what reads answers; ``kept`` ends with the CTE of the
    headings that pass the frame filter."""
    scores = f"""{kept},
hpart AS (SELECT i.heading_id, u.i - 1 AS part_idx, u.part FROM kinfo i JOIN (SELECT DISTINCT heading_id FROM kept) USING (heading_id),
          unnest(list_reverse(string_split(i.heading, ' > '))) WITH ORDINALITY AS u(part, i)),
hsent AS (SELECT heading_id, part_idx, {tag_sentence('s.s')} AS toks FROM hpart, unnest({sentences('part')}) AS s(s)),
hana AS (SELECT heading_id, part_idx, list_distinct(flatten(list({entities(encode('toks'))}))) AS h_entities,
         list_distinct(flatten(list({frames('toks')}))) AS h_frames FROM hsent GROUP BY ALL),
hq AS (SELECT k.q_id, k.sent_idx, k.heading_id, h.part_idx, h.h_entities, h.h_frames, a.q_entities, a.q_frames
       FROM kept k JOIN qan a USING (q_id, sent_idx) JOIN hana h USING (heading_id) WHERE len(h.h_entities) > 0),
hq1 AS (SELECT q_id, sent_idx, heading_id, part_idx, h_entities, unnest(q_entities) AS q_entity FROM hq),
hq2 AS (SELECT q_id, sent_idx, heading_id, part_idx, q_entity, unnest(h_entities) AS h_entity FROM hq1),
ftok AS (SELECT e, list_distinct({fuzzy_tokens('e')}) AS t
         FROM (SELECT q_entity AS e FROM hq2 UNION SELECT h_entity FROM hq2)),
setpair AS (
  SELECT p.h_entity, p.q_entity, array_to_string(list_sort(list_filter(x.t, lambda w: list_contains(y.t, w))), ' ') AS common,
         array_to_string(list_sort(list_filter(x.t, lambda w: NOT list_contains(y.t, w))), ' ') AS ra,
         array_to_string(list_sort(list_filter(y.t, lambda w: NOT list_contains(x.t, w))), ' ') AS rb
  FROM (SELECT DISTINCT h_entity, q_entity FROM hq2) p JOIN ftok x ON x.e = p.h_entity JOIN ftok y ON y.e = p.q_entity
  WHERE len(x.t) > 0 AND len(y.t) > 0),
setside AS (SELECT *, trim(common || ' ' || ra) AS c1, trim(common || ' ' || rb) AS c2 FROM setpair),
setratio AS (
  -- the common part is a prefix of both sides; the Levenshtein distance bounds the ratio of the sides
  SELECT h_entity, q_entity, greatest(
    CASE WHEN common <> '' THEN {percent('length(common)', 'length(common) + length(c1)')} ELSE 0 END,
    CASE WHEN common <> '' THEN {percent('length(common)', 'length(common) + length(c2)')} ELSE 0 END,
    CASE WHEN levenshtein(c1, c2) <= 0.21 * (length(c1) + length(c2))
         THEN {percent(lcs('c1', 'c2'), 'length(c1) + length(c2)')} ELSE 0 END) AS r FROM setside),
hbest AS (SELECT q_id, sent_idx, heading_id, part_idx, q_entity, max(r) AS r FROM hq2 JOIN setratio USING (h_entity, q_entity)
          WHERE r >= {R.FUZZ_ACCEPT} GROUP BY ALL),
hent AS (SELECT q_id, sent_idx, heading_id, part_idx, sum(r)::DOUBLE / count(*)::DOUBLE AS er FROM hbest GROUP BY ALL),
hweight AS (
  SELECT q_id, sent_idx, heading_id, sum(w) AS w FROM (
    SELECT q_id, sent_idx, heading_id, er * (CASE WHEN len(q_frames) = 0 THEN 1.0::DOUBLE ELSE
      len(list_filter(q_frames, lambda f: list_contains(h_frames, f)))::DOUBLE / len(q_frames)::DOUBLE END)
      / pow((part_idx + 1)::DOUBLE, 2) AS w
    FROM hq JOIN hent USING (q_id, sent_idx, heading_id, part_idx)) WHERE w > 0 GROUP BY ALL),
cohpair AS (SELECT DISTINCT w.q_id, w.heading_id, array_to_string({fuzzy_tokens(important('i.heading'))}, ' ') AS hs,
            array_to_string({fuzzy_tokens(important('a.question'))}, ' ') AS qs
            FROM hweight w JOIN kinfo i USING (heading_id) JOIN qan a USING (q_id, sent_idx)),
coh AS (SELECT q_id, heading_id, CASE WHEN hs = '' OR qs = '' THEN 0 ELSE
        {percent(lcs('qs', 'hs'), 'length(qs) + length(hs)')} END / 100.0::DOUBLE AS coherence FROM cohpair),
scored AS (SELECT k.q_id, k.sent_idx, k.heading_id, coalesce(w.w * c.coherence, 0.0::DOUBLE) AS score
           FROM kept k LEFT JOIN hweight w USING (q_id, sent_idx, heading_id) LEFT JOIN coh c USING (q_id, heading_id))"""
    n = R.SENTENCES_PER_ANSWER
    ans = f"""{scores},
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id, sent_idx ORDER BY score DESC, heading_id) AS rank
                          FROM scored) WHERE rank <= {R.ANSWERS_PER_SENTENCE}),
hitlist AS (SELECT q_id, sent_idx, heading_id, list_sort(list(sentence_id)) AS h FROM hits GROUP BY ALL),
spread AS (
  SELECT r.*, i.heading, (CASE WHEN h[1] - i.first_sentence_id BETWEEN 1 AND {n - 1} THEN range(i.first_sentence_id, h[1]) ELSE [] END
    || flatten(list_transform(h, lambda e, k: range(e, 1 + CASE WHEN k < len(h) AND h[k + 1] - e <= {n} THEN h[k + 1] - 1
       ELSE greatest(e, least(e + {n - 1}, i.last_sentence_id)) END))))[1:{n}] AS ids
  FROM ranked r JOIN hitlist USING (q_id, sent_idx, heading_id) JOIN kinfo i USING (heading_id)),
texts AS (SELECT p.q_id, p.sent_idx, p.heading_id, string_agg({rebuilt('s.toks')}, ' ' ORDER BY u.k) AS answer
          FROM spread p, unnest(p.ids) WITH ORDINALITY AS u(sentence_id, k) JOIN ksentences s ON s.sentence_id = u.sentence_id GROUP BY ALL),
answers AS (
  SELECT q_id, sent_idx::INT AS sent_idx, rank::INT AS rank, heading, {lit(R.URL_PREFIX)} || heading_id AS url,
         round_even(score, 2) AS score, coalesce(answer, '') AS answer
  FROM spread LEFT JOIN texts USING (q_id, sent_idx, heading_id)
  UNION ALL
  SELECT q_id, sent_idx::INT, 1, NULL, '', 0.0, {lit(R.DEFAULT_FEEDBACK)} FROM qan a
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.q_id = a.q_id AND k.sent_idx = a.sent_idx))"""
    obj = ("'{' || CASE WHEN heading IS NULL THEN '' ELSE '\"heading\":' || to_json(heading)::VARCHAR || ',' END || '\"url\":' || "
           "to_json(url)::VARCHAR || ',\"score\":' || CAST(score AS VARCHAR) || ',\"answer\":' || to_json(answer)::VARCHAR || '}'")
    edges = f"""edges AS (
  SELECT e.entity AS start, {lit(GR.MENTIONED_UNDER)} AS rel, h.heading AS "end" FROM knorms n JOIN ksentences s USING (sentence_id)
  JOIN kentities e USING (entity_id) JOIN kheadings h USING (heading_id)
  UNION SELECT c.heading, {lit(GR.PART_OF)}, p.heading FROM kheadings c JOIN kheadings p ON p.heading_id = c.parent_id)"""
    return {
        "q10_scores": f"{scores} SELECT q_id, sent_idx, heading_id, round(score, 9) AS score FROM scored",
        "q_answers": f"{ans} SELECT * FROM answers",
        "s10_answers_json": f"""{ans}
SELECT q.q_id, '{{' || CASE WHEN q.question IS NULL THEN '' ELSE '"question":' || to_json(q.question)::VARCHAR || ',' END
       || '"answers":[' || coalesce(j.objs, '') || ']}}' AS json
FROM (SELECT concat_ws('-', conv_id, turn) AS q_id, text AS question FROM conversations WHERE role = 'user') q
LEFT JOIN (SELECT q_id, string_agg({obj}, ',' ORDER BY sent_idx, rank) AS objs FROM answers GROUP BY q_id) j USING (q_id)""",
        "k10_heading_text": f"""{ans}
SELECT s.heading_id, h.heading, string_agg({rebuilt('s.toks')}, ' ' ORDER BY s.sentence_id) AS content
FROM ksentences s JOIN kheadings h USING (heading_id) WHERE s.heading_id IN (SELECT heading_id FROM ranked) GROUP BY ALL""",
        "g1_edges_touching_question_entities": f"""WITH {KB_CTE}, {Q_CTE}, {edges},
terms AS (SELECT DISTINCT unnest(q_entities) AS term FROM qan)
SELECT * FROM edges WHERE start IN (SELECT term FROM terms) OR "end" IN (SELECT term FROM terms)""",
        "g2_edges_between_entity_and_heading": f"""{ans}, {edges},
qterm AS (SELECT q_id, sent_idx, unnest(q_entities) AS t1 FROM qan),
pair AS (SELECT DISTINCT q.t1, a.heading AS t2 FROM qterm q JOIN answers a USING (q_id, sent_idx) WHERE a.heading IS NOT NULL)
SELECT DISTINCT t1, t2, start, rel, "end" FROM pair JOIN edges
  ON (start = t1 AND "end" = t2) OR (start = t2 AND "end" = t1)""",
    }


def all_oracles() -> dict[str, str]:
    out = simple()
    out.update(kb_queries())
    out.update(question_queries())
    return out
