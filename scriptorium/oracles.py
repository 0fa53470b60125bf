"""The registered queries as SQL for DuckDB, to hold their results against. Built from the same rule packs as the queries."""

from __future__ import annotations

from functools import reduce
from html.entities import html5
from types import SimpleNamespace

from scriptorium.functions.html import ESCAPABLE, RAW
from scriptorium.functions.text import ESCAPES, quoted
from scriptorium.operators import report
from scriptorium.operators.catalog import COURSES, KEYWORDS, NOTES, PRESETS
from scriptorium.operators.lessons import SUMMARIES
from scriptorium.plans.rules import LATIN, LECTURE_CLASSICAL, LECTURE_ESSAY, LECTURE_WORDS, PACKS, WS, RulePack


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {lit(f'^{WS}+|{WS}+$')}, '', 'g')"


def escape(c: str) -> str:
    return reduce(lambda x, e: f"replace({x}, {lit(e[0])}, {lit(e[1])})", ESCAPES, c)


def text_length(c: str) -> str:
    c = reduce(lambda x, e: f"replace({x}, {lit(e[1])}, {lit(e[0])})", ESCAPES[::-1], f"regexp_replace({c}, '<[^>]+>', '', 'g')")
    return f"length(regexp_replace({c}, {lit(WS + '+')}, '', 'g'))"


# HTML's tokens as in functions.html, without the parts of patterns that RE2 lacks.
_S = r"\t\n\f\r "
_REST = rf"""(?:[{_S}/]*[^{_S}/>][^{_S}/>=]*(?:[{_S}]*=[{_S}]*(?:"[^"]*"|'[^']*'|[^{_S}>"'][^{_S}>]*)?)?)*[{_S}/]*>"""
_TAG = rf"</?[A-Za-z][^{_S}/>]*{_REST}"
_LONG = "|".join(rf"<{name}(?:[{_S}/]{_REST}|>).*?</{name}(?:[{_S}/][^>]*)?>" for name in RAW + ESCAPABLE)
_TOKENS = rf"(?si)<!---?>|<!--.*?--!?>|{_LONG}|{_TAG}|<[!?][^>]*>|</[^>]*>|[^<]+|<"
_REFERENCE = "&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"


def page_texts() -> str:
    """The text of each page, in pieces: its tokens' texts, and these cut at character references, which a table decodes."""
    inner = rf"regexp_replace(regexp_replace(token, {lit(f'(?si)^{_TAG}')}, ''), '(?si)</[a-z]+[^<>]*>$', '')"
    kind = lambda names: f"regexp_matches(token, {lit(f'(?i)^<(?:{chr(124).join(names)})[{_S}/>]')})"
    names = ", ".join(f"({lit(name)}, {lit(text)})" for name, text in html5.items() if name.endswith(";"))
    code = "CASE WHEN lower(piece[3]) = 'x' THEN ('0x' || regexp_extract(piece, '[0-9a-fA-F]+', 0))::INTEGER ELSE regexp_extract(piece, '[0-9]+', 0)::INTEGER END"
    return f"""names(name, meaning) AS (VALUES {names}),
    tokens AS (SELECT page_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, {lit(_TOKENS)}) AS t FROM pages)),
    parts AS (SELECT page_id, i, CASE WHEN NOT starts_with(token, '<') OR token = '<' THEN token WHEN {kind(RAW + ESCAPABLE)} THEN {inner} ELSE '' END AS part, NOT ({kind(RAW)}) AS refers FROM tokens),
    pieces AS (SELECT page_id, i, refers, unnest(p) AS piece, generate_subscripts(p, 1) AS j FROM (SELECT *, CASE WHEN refers THEN regexp_extract_all(part, {lit(_REFERENCE)}) ELSE [part] END AS p FROM parts)),
    texts AS (SELECT page_id, i, j, CASE WHEN NOT refers THEN piece WHEN starts_with(piece, '&#') THEN chr({code}) ELSE coalesce(n.meaning, piece) END AS text FROM pieces LEFT JOIN names n ON starts_with(piece, '&') AND n.name = substr(piece, 2))"""


def format_chars(c: str) -> str:
    return f"CASE WHEN {c} >= 10000 THEN printf('%.2f', (({c} + 50) // 100) / 100.0) || ' 万字' ELSE greatest(1, ({c} + 50) // 100 * 100)::VARCHAR || ' 字' END"


def compression(chars: str, raw: str) -> str:
    return f"CASE WHEN coalesce({raw}, 0) = 0 THEN '' ELSE '约 ' || round({chars}::DOUBLE / {raw} * 100)::BIGINT::VARCHAR || '%' END"


def meta(template: str, *args: str) -> str:
    parts = template.replace("%s", "%d").replace("%%", "\x02").split("%d")
    out = [lit(parts[0].replace("\x02", "%"))]
    for a, part in zip(args, parts[1:]):
        out += [a, lit(part.replace("\x02", "%"))]
    return " || ".join(out)


def p_meta(template: str, *args: str) -> str:
    return "'<p class=\"chunk-meta\">' || " + meta(template, *args) + " || '</p>'"


def button(label: str, to: str) -> str:
    return f"'<button class=\"tiny-button\" data-jump-chunk=\"' || {to} || '\" ' || CASE WHEN {to} = '' THEN 'disabled' ELSE '' END || '>{label}</button>'"


def tables(P: RulePack, documents: str = "documents") -> SimpleNamespace:
    """CTEs and expressions of a pack over (doc_id, text) in `documents`."""

    def clean(c: str) -> str:
        c = f"regexp_replace({c}, {lit(chr(92) + 'A(?:' + P.timestamp + ')' + WS + '*')}, '')"
        c = reduce(lambda x, r: f"regexp_replace({x}, {lit(r[0])}, {lit(r[1])}, 'g')", P.sql_clean, c)
        c = reduce(lambda x, r: f"replace({x}, {lit(r[0])}, {lit(r[1])})", P.replacements, c)
        c = reduce(lambda x, t: f"regexp_replace({x}, {lit(quoted(t) + '{2,}')}, {lit(t)}, 'g')", P.terminators, c)
        comma = "，" if "，" in P.trim else ","
        return f"trim(regexp_replace({c}, {lit(f'[，,]{WS}*[，,]+')}, {lit(comma)}, 'g'), {lit(P.trim)})"

    def noise(c: str) -> str:
        longer, ends, chars = P.noise
        return f"length({c}) > {longer} AND len(regexp_extract_all({c}, {lit(quoted(P.noise_terminators))})) <= {ends} AND length({c}) - length(replace({c}, {lit(P.noise_char)}, '')) > {chars}"

    def marked(c: str) -> str:
        return f"starts_with({c}, {lit(P.noise_marker[:5])})"

    def noisy_text(c: str) -> str:
        return f"{lit(P.noise_marker)} || substr({c}, 1, {P.noise_cut}) || '...'"

    def title(c: str, number: str) -> str:
        groups = lambda rule: " AND ".join("(" + " OR ".join(f"contains({c}, {lit(w)})" for w in g) + ")" for g in rule.groups)
        return "CASE " + " ".join(f"WHEN {groups(r)} THEN {lit(r.title)}" for r in P.titles) + f" ELSE {lit(P.untitled)} || {number} END"

    def words(c: str, of: tuple[str, ...]) -> str:
        return "2 * (" + " + ".join(f"contains({c}, {lit(w)})::BIGINT" for w in of) + ")"


    STUDY = f"({words('sentence', P.study_words)} + (length(sentence) BETWEEN {P.study_band[0]} AND {P.study_band[1]})::BIGINT - {P.noise_penalty[0]} * {marked('sentence')}::BIGINT)"
    DIGEST = f"({words('sentence', P.digest_words)} + 2 * (length(sentence) BETWEEN {P.digest_band[0]} AND {P.digest_band[1]})::BIGINT + (position <= {P.early})::BIGINT - {P.noise_penalty[1]} * {marked('sentence')}::BIGINT)"

    LINES = f"""paras AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS para_no, raw FROM
      (SELECT doc_id, i, {strip("l")} AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {documents}))
      WHERE length(raw) > 0)"""
    KEPT = f"""{LINES}, cleaned AS MATERIALIZED (SELECT doc_id, para_no, {clean("raw")} AS text FROM paras),
    kept AS MATERIALIZED (SELECT c.doc_id, c.para_no, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.para_no) AS k, CASE WHEN {noise("c.text")} THEN {noisy_text("c.text")} ELSE c.text END AS text
      FROM cleaned c JOIN paras p USING (doc_id, para_no) WHERE c.para_no > 1 AND NOT regexp_matches(p.raw, {lit(chr(92) + "A(?:" + P.timestamp + ")" + chr(92) + "z")}) AND length(c.text) > 0)"""
    FOLD = f"""{KEPT}, sized AS MATERIALIZED (SELECT doc_id, k, length(text) AS n FROM kept),
    fold AS (SELECT doc_id, k, 1::BIGINT AS chunk_no, n AS used FROM sized WHERE k = 1 UNION ALL
      SELECT s.doc_id, s.k, CASE WHEN f.used + s.n > {P.max_chars} THEN f.chunk_no + 1 ELSE f.chunk_no END, CASE WHEN f.used + s.n > {P.max_chars} THEN s.n ELSE f.used + s.n END
      FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
    placed AS MATERIALIZED (SELECT k.doc_id, f.chunk_no, k.k, k.para_no, k.text, row_number() OVER (PARTITION BY k.doc_id, f.chunk_no ORDER BY k.k) AS pos FROM kept k JOIN fold f USING (doc_id, k)),
    grouped AS (SELECT doc_id, chunk_no, min(para_no) AS first_no, count(*) AS n_paras, sum(length(text))::BIGINT AS raw_chars, string_agg(text, chr(10) ORDER BY k) AS body FROM placed GROUP BY ALL),
    chunks AS MATERIALIZED (SELECT g.doc_id, chunk_no, printf('c%02d', chunk_no) AS chunk_id, {title("body", "chunk_no")} AS title, CASE WHEN chunk_no = 1 THEN 1 ELSE first_no END AS start_para,
      coalesce(lead(first_no) OVER (PARTITION BY g.doc_id ORDER BY chunk_no) - 1, r.n) AS end_para, raw_chars, n_paras, body,
      CASE WHEN chunk_no > 1 THEN printf('c%02d', chunk_no - 1) ELSE '' END AS prev_chunk, CASE WHEN chunk_no < count(*) OVER (PARTITION BY g.doc_id) THEN printf('c%02d', chunk_no + 1) ELSE '' END AS next_chunk
      FROM grouped g JOIN (SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id) r ON r.doc_id = g.doc_id)"""
    _PARTS = f"string_split(regexp_replace(text, {lit('(' + quoted(P.terminators) + ')')}, '\\1' || chr(1), 'g'), chr(1))"
    SENTENCES = f"""{FOLD}, pieces AS (SELECT doc_id, chunk_no, k, unnest({_PARTS}) AS piece, generate_subscripts({_PARTS}, 1) AS i FROM placed),
    sentences AS MATERIALIZED (SELECT doc_id, chunk_no, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY k, i) AS ord, row_number() OVER (PARTITION BY doc_id, chunk_no, k ORDER BY i) AS position, sentence
      FROM (SELECT doc_id, chunk_no, k, i, {strip("piece")} AS sentence FROM pieces) WHERE length(sentence) >= {P.sentence})"""

    def points(name: str, limit: int, cut: int | None = None, score: str = STUDY) -> str:
        least, fallback = P.fallback
        sentence = f"substr(sentence, 1, {cut})" if cut else "sentence"
        return f"""{name}_first AS MATERIALIZED (SELECT doc_id, chunk_no, rank, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY score DESC, ord) AS rank FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_no, substr(sentence, 1, {P.prefix}) ORDER BY score DESC, ord) AS n FROM (SELECT *, {score} AS score FROM sentences) WHERE score > 0) WHERE n = 1) WHERE rank <= {limit}),
    {name}_more AS (SELECT c.doc_id, c.chunk_no, coalesce(m.many, 0) + row_number() OVER (PARTITION BY c.doc_id, c.chunk_no ORDER BY p.k) AS rank, substr(p.text, 1, {fallback}) AS sentence
      FROM chunks c LEFT JOIN (SELECT doc_id, chunk_no, count(*) AS many FROM {name}_first GROUP BY ALL) m ON m.doc_id = c.doc_id AND m.chunk_no = c.chunk_no
      JOIN placed p ON p.doc_id = c.doc_id AND p.chunk_no = c.chunk_no WHERE coalesce(m.many, 0) < {least} AND NOT {marked("p.text")}),
    {name} AS MATERIALIZED (SELECT doc_id, chunk_no, rank, {sentence} AS sentence FROM (SELECT * FROM {name}_first UNION ALL SELECT * FROM {name}_more WHERE rank <= {limit}))"""

    def digest(score: str = DIGEST) -> str:
        target = f"greatest({P.budget[0]}, raw_chars * {P.budget[1]} // 100)"
        before = "coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id, chunk_no ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        return f"""scored AS MATERIALIZED (SELECT s.*, c.raw_chars, {score} AS score FROM sentences s JOIN chunks c USING (doc_id, chunk_no)),
    whole AS (SELECT p.doc_id, p.chunk_no, row_number() OVER (PARTITION BY p.doc_id, p.chunk_no ORDER BY p.k) AS ord, p.text AS sentence, c.raw_chars FROM placed p JOIN chunks c USING (doc_id, chunk_no)
      WHERE NOT {marked("p.text")} AND NOT EXISTS (SELECT 1 FROM scored s WHERE s.score > 0 AND s.doc_id = p.doc_id AND s.chunk_no = p.chunk_no)),
    digest AS MATERIALIZED (SELECT doc_id, chunk_no, ord, sentence FROM (SELECT *, {before.format("score DESC, ord")} AS before FROM scored WHERE score > 0) WHERE before < {target}
      UNION ALL SELECT doc_id, chunk_no, ord, sentence FROM (SELECT *, {before.format("ord")} AS before FROM whole) WHERE before < {target}),
    digest_groups AS MATERIALIZED (SELECT doc_id, chunk_no, group_no, string_agg(sentence, '' ORDER BY ord) AS text FROM
      (SELECT *, (row_number() OVER (PARTITION BY doc_id, chunk_no ORDER BY ord) - 1) // {P.group} + 1 AS group_no FROM digest) GROUP BY doc_id, chunk_no, group_no)"""


    FOOTER = f"'<nav class=\"chunk-footer\">' || {button(report.FOOTER[0], 'prev_chunk')} || '<button class=\"tiny-button\" data-jump-toc>{report.FOOTER[1]}</button>' || {button(report.FOOTER[2], 'next_chunk')} || '</nav>'"

    def section(*parts: str) -> str:
        return f"'<section class=\"long-section\" id=\"' || chunk_id || '\"><h2>' || {escape('title')} || '</h2>' || " + " || ".join(parts) + " || '</section>'"

    def rendered(name: str, html: str, rows: str | None = None, order: str = "", item: str = "", value: str = "") -> str:
        """A CTE of the sections' HTML; rows: the CTE with their items."""
        if rows is None:
            rows, order, item, value = "placed", "k", "p", "text"
        items = f"SELECT doc_id, chunk_no, count(*) AS many, string_agg('<{item}>' || {escape(value)} || '</{item}>', chr(10) ORDER BY {order}) AS items FROM {rows} GROUP BY ALL"
        return f"{name} AS MATERIALIZED (SELECT doc_id, chunk_no, chunk_id, {html} AS html FROM (SELECT c.*, coalesce(i.items, '') AS items, coalesce(i.many, 0) AS many FROM chunks c LEFT JOIN ({items}) i ON i.doc_id = c.doc_id AND i.chunk_no = c.chunk_no))"


    RAW = rendered("html_raw", f"'<section class=\"raw-chunk\"><h2>' || {escape('title')} || '</h2>' || {p_meta(report.RAW_META, 'start_para', 'end_para', 'raw_chars')} || items || '</section>'")
    CLEAN = rendered("html_clean", section(p_meta(report.CLEAN_META, "chunk_id", "start_para", "end_para", "raw_chars"), "items", FOOTER))
    HTML_DIGEST = rendered("html_digest", section(p_meta(report.DIGEST_META, "start_para", "end_para"), "items", FOOTER), "digest_groups", "group_no", "p", "text")
    HTML_STUDY = rendered("html_study", section(p_meta(report.STUDY_META, "start_para", "end_para", "many"), "'<ul>' || items || '</ul>'", FOOTER), "study", "rank", "li", "sentence")
    HTML_OUTLINE = rendered(
        "html_outline",
        f"'<li id=\"' || chunk_id || '\" class=\"outline-chunk\"><strong>' || {escape('title')} || '</strong><span class=\"chunk-meta\">' || {meta(report.OUTLINE_META, 'chunk_id', 'start_para', 'end_para')} || '</span><ul>' || items || '</ul></li>'",
        "outline", "rank", "li", "sentence",
    )
    STUDY_POINTS, OUTLINE_POINTS = points("study", P.study_limit), points("outline", P.outline_limit, P.outline_cut)
    NO_POINTS, NO_DIGEST = points("study", P.study_limit, score="0"), digest("0")

    def whole(name: str) -> str:
        joined = "string_agg(html, chr(10) ORDER BY chunk_no)"
        if name == "html_outline":
            joined = f"'<section class=\"long-section\"><h2>{report.OUTLINE_TITLE}</h2><ol class=\"outline-list\">' || {joined} || '</ol></section>'"
        return f"SELECT doc_id, {joined} AS html FROM {name} GROUP BY doc_id"


    STATS = f"""{FOLD}, stats AS MATERIALIZED (SELECT d.doc_id, coalesce(r.n, 0) AS paragraphs, coalesce(r.chars, 0)::BIGINT AS raw_chars, coalesce(k.chars, 0)::BIGINT AS clean_chars, coalesce(c.n, 0) AS chunks, {P.max_chars}::BIGINT AS chunk_target_chars
      FROM {documents} d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(raw)) AS chars FROM paras GROUP BY doc_id) r USING (doc_id)
      LEFT JOIN (SELECT doc_id, sum(length(text)) AS chars FROM kept GROUP BY doc_id) k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id))"""

    return SimpleNamespace(**locals())


L = tables(LATIN)


def q(base: str, *more: str) -> str:
    """The last of `more` selects from the tables before it."""
    return "WITH RECURSIVE " + ", ".join([base, *more[:-1]]) + "\n" + more[-1]


def resources() -> str:
    pick = " ".join(f"WHEN {i} THEN [{', '.join(map(lit, PRESETS[k]))}][turn // 3 % {len(PRESETS[k])} + 1]" for i, k in enumerate(PRESETS))
    kind = " ".join(f"WHEN {i} THEN {lit(k)}" for i, k in enumerate(PRESETS))
    return f"resources AS (SELECT conv_id AS lesson_id, CASE turn % 3 {kind} END AS kind, turn // 3 AS ord, text AS title, CASE turn % 3 {pick} END AS chunk_id, turn % 3 AS part FROM conversations)"


_STAMPS = "turns AS (SELECT conv_id, turn, printf('%s 00:%02d:%02d', role, turn // 60 % 60, turn % 60) AS stamp, text FROM conversations), lines AS (SELECT conv_id, turn, unnest([stamp, stamp || '  ' || text, text]) AS line FROM turns)"
_FLAGS = "[" + ", ".join(map(lit, LATIN.flags)) + "]"

_SIBLINGS = "SELECT doc_id, coalesce(lag(doc_id) OVER (ORDER BY doc_id), max(doc_id) OVER ()) AS prev_id, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM documents"
_LEXICON = r"lexicon AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}{4,}')) AS word FROM benchmark)"
_INNER = "SELECT doc_id, part, '<section id=\"p' || part || '\">' || string_agg(html, '' ORDER BY chunk_no) || '</section>' AS html FROM (SELECT *, (chunk_no - 1) // 3 AS part FROM html_clean) GROUP BY doc_id, part"

ORACLES = {
    "gen_paragraph": q(L.LINES, "SELECT doc_id, para_no, raw FROM paras"),
    "src_docx": q(L.LINES, "SELECT doc_id, para_no, raw FROM paras"),
    "src_registry": "SELECT * FROM (VALUES " + ", ".join(f"({lit(p.name)}, {lit(p.untitled)}, {lit(p.noise_text)}, {lit(f'/packs/{p.name}.docx')}, {p.max_chars}::BIGINT, {lit(f'{p.name}.docx')})" for p in PACKS.values()) + ") t(sample_id, title, subtitle, source, max_chars, file)",
    "flt_header": q(L.LINES, "SELECT doc_id, count(*) AS kept, min(para_no) AS first_no FROM paras WHERE para_no > 1 GROUP BY doc_id"),
    "flt_timestamp": q(_STAMPS, f"SELECT conv_id, turn, regexp_replace(line, {lit(chr(92) + 'A(?:' + LATIN.timestamp + ')[' + chr(92) + 't-' + chr(92) + 'r ]*')}, '') AS line FROM lines WHERE NOT regexp_matches(line, {lit(chr(92) + 'A(?:' + LATIN.timestamp + ')' + chr(92) + 'z')})"),
    "cln_rules": q(L.LINES, f"SELECT doc_id, para_no, {L.clean('raw')} AS text FROM paras"),
    "flt_empty_clean": q(L.KEPT, "SELECT doc_id, para_no, text FROM kept"),
    "flt_noise_flag": q(L.KEPT, f"SELECT doc_id, para_no, {L.noisy_text('text')} AS text FROM cleaned WHERE {L.noise('text')}"),
    "seg_fold": q(L.FOLD, "SELECT doc_id, chunk_no, start_para, end_para, n_paras, raw_chars AS chars FROM chunks"),
    "seg_fold_long": q(L.FOLD, "SELECT doc_id, chunk_no, start_para, end_para, n_paras, raw_chars AS chars FROM chunks"),
    "seg_fold_stream": q(L.FOLD, "SELECT doc_id, chunk_no, start_para, end_para, n_paras, raw_chars AS chars FROM chunks"),
    "gen_chunk": q(L.FOLD, "SELECT doc_id, chunk_no, pos, para_no FROM placed"),
    "agg_chunk_body": q(L.FOLD, "SELECT doc_id, chunk_id, body FROM chunks"),
    "fn_title_first_match": q(L.FOLD, "SELECT doc_id, chunk_id, title FROM chunks"),
    "nav_chunk": q(L.FOLD, "SELECT doc_id, chunk_id, prev_chunk, next_chunk FROM chunks"),
    "nav_current": q(L.FOLD, "SELECT doc_id, chunk_id, upper(chunk_id) AS label FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id <> 'c02', chunk_no) = 1"),
    "out_toc": q(L.FOLD, "SELECT doc_id, upper(chunk_id) AS label, title, start_para, end_para, raw_chars FROM chunks"),
    "flt_compact": q(L.FOLD, f"SELECT doc_id, chunk_id, title, {meta(report.RAW_META, 'start_para', 'end_para', 'raw_chars')} AS meta FROM chunks"),
    "gen_sentence": q(L.SENTENCES, "SELECT doc_id, chunk_no, ord, position, sentence FROM sentences"),
    "rank_study_score": q(L.SENTENCES, f"SELECT doc_id, chunk_no, ord, {L.STUDY} AS score FROM sentences WHERE {L.STUDY} > 0"),
    "rank_digest_score": q(L.SENTENCES, f"SELECT doc_id, chunk_no, ord, {L.DIGEST} AS score FROM sentences WHERE {L.DIGEST} > 0"),
    "agg_keyword_score": q(L.SENTENCES, f"SELECT doc_id, chunk_no, ord, {L.words('sentence', LATIN.study_words)} AS score FROM sentences"),
    "agg_lexicon_score": q(L.SENTENCES, _LEXICON, "SELECT doc_id, chunk_no, ord, 2 * count(*) AS score FROM sentences JOIN lexicon ON contains(sentence, word) GROUP BY ALL"),
    "agg_lexicon_words": f"WITH {_LEXICON} SELECT word, count(*) AS documents FROM documents JOIN lexicon ON contains(text, word) GROUP BY word",
    "topk_study": q(L.SENTENCES, L.STUDY_POINTS, "SELECT * FROM study"),
    "topk_outline": q(L.SENTENCES, L.OUTLINE_POINTS, "SELECT * FROM outline"),
    "topk_fallback": q(L.SENTENCES, L.NO_POINTS, "SELECT * FROM study"),
    "budget_digest": q(L.SENTENCES, L.digest(), "SELECT * FROM digest"),
    "budget_fallback": q(L.SENTENCES, L.NO_DIGEST, "SELECT * FROM digest"),
    "gen_digest_group": q(L.SENTENCES, L.digest(), "SELECT * FROM digest_groups"),
    "agg_point_count": q(L.SENTENCES, L.STUDY_POINTS, "SELECT doc_id, chunk_no, count(*) AS points FROM study GROUP BY ALL"),
    "agg_stats": q(L.STATS, "SELECT * FROM stats"),
    "fn_review_flags": q(L.KEPT, f"""SELECT doc_id, generate_subscripts(flags, 1) AS flag_no, unnest(flags) AS flag FROM (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = d.doc_id AND contains(k.text, {lit(LATIN.noise_text)}))
  THEN list_append({_FLAGS}, {lit(LATIN.noise_flag)}) ELSE {_FLAGS} END AS flags FROM documents d)"""),
    "agg_exists_noise": q(L.KEPT, f"SELECT doc_id, bool_or(contains(text, {lit(LATIN.noise_text)})) AS noisy FROM kept GROUP BY doc_id"),
    "out_clean": q(L.FOLD, "SELECT c.doc_id, chunk_id, title, start_para, end_para, raw_chars, p.para_no, p.text FROM chunks c JOIN placed p USING (doc_id, chunk_no)"),
    "out_raw": q(L.FOLD, L.RAW, "SELECT doc_id, chunk_id, html FROM html_raw"),
    "out_digest": q(L.SENTENCES, L.digest(), f"SELECT doc_id, printf('c%02d', chunk_no) AS chunk_id, group_no, {escape('text')} AS html FROM digest_groups"),
    "snk_html_digest": q(L.SENTENCES, L.digest(), L.HTML_DIGEST, "SELECT doc_id, chunk_id, html FROM html_digest"),
    "out_study": q(L.SENTENCES, L.STUDY_POINTS, L.HTML_STUDY, "SELECT doc_id, chunk_id, html FROM html_study"),
    "out_outline": q(L.SENTENCES, L.OUTLINE_POINTS, L.HTML_OUTLINE, "SELECT doc_id, chunk_id, html FROM html_outline"),
    "agg_version_stats": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.digest(), L.STUDY_POINTS, L.OUTLINE_POINTS, L.CLEAN, L.HTML_DIGEST, L.HTML_STUDY, L.HTML_OUTLINE,
        "every AS (" + " UNION ALL ".join(f"SELECT doc_id, '{v}' AS version, {text_length('html')} AS chars FROM ({L.whole(f'html_{v}')})" for v in ("clean", "digest", "study", "outline")) + " UNION ALL SELECT doc_id, 'raw', greatest(raw_chars, 1) FROM stats)",
        "SELECT doc_id, version, CASE version " + " ".join(f"WHEN {lit(k)} THEN {lit(v[0])}" for k, v in report.LABELS.items()) + " END AS label, chars, CASE version " + " ".join(f"WHEN {lit(k)} THEN {lit(v[1])}" for k, v in report.LABELS.items()) + " END AS tone FROM every",
    ),
    "out_overview": q(L.STATS, f"SELECT s.doc_id, chunks, {format_chars('raw_chars')} AS raw_size, {format_chars('clean_chars')} AS clean_size, {compression('clean_chars', 'raw_chars')} AS share, coalesce(l.quality, -1)::BIGINT AS quality FROM stats s LEFT JOIN labels l ON l.doc_id = s.doc_id"),
    "out_sample": q(L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.STUDY_POINTS, L.HTML_STUDY, f"SELECT s.doc_id, paragraphs, clean_chars, chunks, {lit(LATIN.flags[0])} AS first_flag, coalesce(length(w.html), 0) AS study_length FROM stats s LEFT JOIN ({L.whole('html_study')}) w ON w.doc_id = s.doc_id"),
    "fn_html_strip": f"WITH {page_texts()} SELECT page_id, sum(length(regexp_replace(text, {lit(WS + '+')}, '', 'g')))::BIGINT AS chars FROM texts GROUP BY page_id",
    "fn_html_text": f"WITH {page_texts()} SELECT page_id, md5(string_agg(text, '' ORDER BY i, j)) AS text FROM texts GROUP BY page_id",
    "fn_html_escape": f"SELECT page_id, {escape('html')} AS html FROM pages",
    "fn_basename": "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages",
    "fn_hash_route": "SELECT doc_id, CASE WHEN toxic > 0 THEN '' ELSE doc_id::VARCHAR END AS course_id FROM labels",
    "fn_format_chars": f"SELECT doc_id, {format_chars('n_chars')} AS size FROM documents",
    "fn_compression": f"SELECT o_orderkey, {compression('floor(o_totalprice)', '(o_orderkey * 100)')} AS share FROM orders",
    "fn_round": "SELECT doc_id, round(n_chars / 100)::BIGINT AS hundreds FROM documents",
    "join_lesson_full": "SELECT d.doc_id, lang, coalesce('label ' || l.quality::VARCHAR, d.source) AS source, coalesce(l.toxic::BIGINT, d.n_chars) AS chars, l.doc_id IS NOT NULL AS has_full FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "join_keyword_ref": "SELECT n_name, coalesce(r_name, 'none') AS r_name FROM nation LEFT JOIN region ON n_nationkey % 7 > 0 AND r_regionkey = n_regionkey",
    "join_ref_key": "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey",
    "join_chunk_assign": q(resources(), "SELECT lesson_id, kind, ord, chunk_id FROM resources"),
    "agg_resource_counts": q(resources(), "SELECT lesson_id, chunk_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in PRESETS) + " FROM resources GROUP BY lesson_id, chunk_id"),
    "flt_chunk_scope": q(resources(), "scoped AS (SELECT *, count(*) FILTER (chunk_id = 'c02') OVER w AS here, row_number() OVER (w ORDER BY ord) AS n FROM resources WINDOW w AS (PARTITION BY lesson_id, kind))", "SELECT lesson_id, kind, ord, chunk_id FROM scoped WHERE CASE WHEN here > 0 THEN chunk_id = 'c02' ELSE n <= 3 END"),
    "set_union_resources": q(resources(), "SELECT lesson_id, kind, ord, chunk_id, 0::BIGINT AS part FROM resources UNION ALL SELECT item_id, 'cards', 0, 'c08', 1 FROM benchmark"),
    "set_union_cards": "SELECT conv_id, turn, 0::BIGINT AS part FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role <> 'user' UNION ALL (SELECT conv_id, turn, 2 FROM conversations ORDER BY conv_id, turn LIMIT 2)",
    "set_dedupe_prefix": q(L.LINES, f"SELECT doc_id, min(para_no) AS para_no, substr(raw, 1, {LATIN.prefix}) AS prefix FROM paras GROUP BY doc_id, prefix"),
    "join_compare": q(L.FOLD, L.RAW, "SELECT doc_id, chunk_id, length(html) AS raw_length, chunk_no % 2 = 0 AS whole FROM html_raw"),
    "nav_sibling": _SIBLINGS,
    "limit_head": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 3",
    "flt_course_ui": "SELECT p_partkey, p_name AS title FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') OR contains(lower(p_type), 'a')) AND p_type = (SELECT min(p_type) FROM part)",
    "out_assets": """WITH lists AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS points, list(text ORDER BY turn) FILTER (role = 'system') AS examples, [min(text)] AS summary FROM conversations GROUP BY conv_id),
details AS (SELECT conv_id, CASE WHEN len(points) > 0 THEN points WHEN len(examples) > 0 THEN examples ELSE summary END AS d FROM lists)
SELECT conv_id, len(d) AS items, d[1] AS first_item FROM details""",
    "fn_section_by_id": q(L.FOLD, L.CLEAN, f"SELECT w.doc_id, md5(coalesce(s.html, w.html)) AS section FROM ({L.whole('html_clean')}) w LEFT JOIN html_clean s ON s.doc_id = w.doc_id AND s.chunk_id = 'c02'"),
    "fn_element_index": f"SELECT page_id, lower(regexp_extract(token, '^<([A-Za-z0-9]+)', 1)) AS name, count(*) AS elements FROM (SELECT page_id, unnest(regexp_extract_all(html, {lit(_TOKENS)})) AS token FROM pages) WHERE regexp_matches(token, '^<[A-Za-z]') GROUP BY ALL",
    "fn_section_nested": q(L.FOLD, L.CLEAN, f"inner_parts AS ({_INNER})", "whole_pages AS (SELECT doc_id, string_agg(html, '' ORDER BY part) AS html FROM inner_parts GROUP BY doc_id)", "SELECT w.doc_id, a.id, md5(coalesce(p.html, c.html, w.html)) AS section FROM whole_pages w CROSS JOIN (VALUES ('p0'), ('p1'), ('c05')) a(id) LEFT JOIN inner_parts p ON p.doc_id = w.doc_id AND 'p' || p.part = a.id LEFT JOIN html_clean c ON c.doc_id = w.doc_id AND c.chunk_id = a.id"),
    "fn_inject_block": q(
        L.FOLD, L.CLEAN, f"places AS (SELECT doc_id, html, CASE WHEN contains(html, ' id=\"c02\">') THEN strpos(html, ' id=\"c02\">') ELSE strpos(html, ' id=\"c01\">') END AS s FROM ({L.whole('html_clean')}))",
        "SELECT doc_id, s + strpos(substr(html, s), '</p>') + 3 AS at FROM places",
    ),
}

#: documents with words of lectures in place of some of their own
LECTURES = "(SELECT doc_id, " + reduce(lambda x, r: f"replace({x}, {lit(r[0]).replace(chr(10), "' || chr(10) || '")}, {lit(r[1]).replace(chr(10), "' || chr(10) || '")})", LECTURE_WORDS, "text") + " AS text FROM documents)"
_CLASSICAL, _ESSAY = tables(LECTURE_CLASSICAL, LECTURES), tables(LECTURE_ESSAY, LECTURES)
_CLEANING = ("cln_filler_latin", "cln_filler_cjk", "cln_laugh", "cln_tag_isnt", "cln_tag_right", "cln_tag_understand", "cln_tag_gotit", "cln_ok_lookahead", "cln_stutter")
ORACLES |= {name: q(_CLASSICAL.LINES, f"SELECT doc_id, para_no, regexp_replace(raw, {lit(rule[0])}, {lit(rule[1])}, 'g') AS text FROM paras") for name, rule in zip(_CLEANING, LECTURE_CLASSICAL.sql_clean)}
ORACLES |= {
    "lecture_cleaned": q(_CLASSICAL.KEPT, "SELECT doc_id, para_no, text FROM kept"),
    "lecture_sections": q(_CLASSICAL.FOLD, "SELECT doc_id, chunk_no, title, start_para, end_para, raw_chars AS chars FROM chunks"),
    "lecture_essay_titles": q(_ESSAY.FOLD, "SELECT doc_id, chunk_id, title FROM chunks"),
    "lecture_study": q(_CLASSICAL.SENTENCES, _CLASSICAL.STUDY_POINTS, "SELECT * FROM study"),
    "lecture_digest": q(_ESSAY.SENTENCES, _ESSAY.digest(), "SELECT * FROM digest_groups"),
    "lecture_flags": q(_CLASSICAL.KEPT, f"""SELECT doc_id, generate_subscripts(flags, 1) AS flag_no, unnest(flags) AS flag FROM (SELECT d.doc_id, CASE WHEN EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = d.doc_id AND contains(k.text, {lit(LECTURE_CLASSICAL.noise_text)}))
  THEN list_append(f, {lit(LECTURE_CLASSICAL.noise_flag)}) ELSE f END AS flags FROM (SELECT doc_id, [{", ".join(map(lit, LECTURE_CLASSICAL.flags))}] AS f FROM documents) d)"""),
}

_SHOWN = "title || ' · ' || teacher AS shown, type, status, CASE WHEN review_count > 0 THEN review_count::VARCHAR || ' 条' ELSE '无' END AS review"
_COURSES = "courses AS (SELECT p_partkey AS id, p_name AS title, p_brand AS teacher, p_type AS type, CASE WHEN p_size % 2 = 0 THEN '已完成' ELSE '处理中' END AS status, (p_size % 3)::BIGINT AS review_count FROM part)"
_DRAWER = """own AS (SELECT conv_id AS lesson_id, turn // 2 AS ord, role AS type, text AS title FROM conversations WHERE turn % 2 = 0),
every AS (SELECT row_number() OVER (ORDER BY conv_id, turn, text) - 1 AS ord, role AS type, text AS title FROM conversations),
words AS (SELECT item_id AS ord, 'word' AS type, text AS title FROM (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT conv_id AS lesson_id, unnest([turn * 3, conv_id * 2 + turn]) AS ord FROM conversations),
found AS (SELECT a.lesson_id, a.ord, coalesce(o.title, e.title, w.title) AS title, CASE WHEN o.title IS NOT NULL THEN o.type WHEN e.title IS NOT NULL THEN e.type ELSE w.type END AS type, CASE WHEN o.title IS NOT NULL THEN 0 WHEN e.title IS NOT NULL THEN 1 ELSE 2 END::BIGINT AS level
  FROM asked a LEFT JOIN own o ON o.lesson_id = a.lesson_id AND o.ord = a.ord LEFT JOIN every e ON e.ord = a.ord LEFT JOIN words w ON w.ord = a.ord WHERE coalesce(o.title, e.title, w.title) IS NOT NULL)"""
_STATS_TEXT = "paragraphs::VARCHAR || ' 段 / 原文约 ' || printf('%.2f', round(raw_chars / 10000.0, 2)) || ' 万字 / ' || chunks::VARCHAR || ' 个处理块'"
ORACLES |= {
    "src_literals": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([*map(lit, c[:-1]), f"{c[-1]}::BIGINT"]) + ")" for c in COURSES) + ") t(id, title, subtitle, teacher, type, status, updated, review_count)",
    "src_generated": q(L.STATS, "SELECT doc_id, paragraphs, raw_chars, chunks FROM stats"),
    "snk_json": q(L.STATS, """SELECT doc_id, '{"doc_id":' || doc_id || ',"paragraphs":' || paragraphs || ',"raw_chars":' || raw_chars || ',"clean_chars":' || clean_chars || ',"chunks":' || chunks || ',"chunk_target_chars":' || chunk_target_chars || '}' AS json FROM stats"""),
    "out_courses": f"WITH {_COURSES} SELECT id, {_SHOWN} FROM courses",
    "out_recent": f"WITH {_COURSES} SELECT id, {_SHOWN} FROM courses ORDER BY id LIMIT 3",
    "out_detail": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.STUDY_POINTS, L.HTML_STUDY,
        f"SELECT s.doc_id, d.lang || '｜' || coalesce(d.source, '') AS header, {_STATS_TEXT} AS stats_text, coalesce(l.n, 0) AS review_count, md5(coalesce(w.html, '')) AS body FROM stats s JOIN documents d USING (doc_id) LEFT JOIN ({L.whole('html_study')}) w ON w.doc_id = s.doc_id LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY conv_id) l ON l.conv_id = s.doc_id",
    ),
    "fn_overview": "SELECT doc_id, CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(v[0])}" for k, v in KEYWORDS.items() if k) + f" ELSE {lit(KEYWORDS[''][0])} END AS first_keyword, CASE lang " + " ".join(f"WHEN {lit(k)} THEN {len(v)}::BIGINT" for k, v in KEYWORDS.items() if k) + f" ELSE {len(KEYWORDS[''])}::BIGINT END AS keywords FROM documents",
    "join_drawer": f"WITH {_DRAWER} SELECT lesson_id, ord, level, title FROM found",
    "out_drawer": f"WITH {_DRAWER} SELECT lesson_id, ord, '<p class=\"page-kicker\">' || {escape('type')} || '</p><h2>' || {escape('title')} || '</h2>' AS html FROM found",
    "out_classics_block": "WITH refs AS (SELECT n_nationkey AS key, n_name AS quote, 'of ' || r_name AS translation, list_slice([n_name, r_name, 'a & b', '<i>', 'fifth'], 1, 4) AS terms FROM nation JOIN region ON r_regionkey = n_regionkey), versions AS (SELECT unnest(['clean', 'digest', 'study', 'outline']) AS version)\n"
    + f"SELECT key, version, '<aside class=\"classical-appreciation-block\"><p class=\"classical-original\">' || {escape('quote')} || '</p><p>' || {escape('translation')} || '</p><ul>' || (SELECT string_agg('<li>' || {escape('t')} || '</li>', '' ORDER BY i) FROM (SELECT unnest(terms) AS t, generate_subscripts(terms, 1) AS i)) || '</ul><p class=\"teacher-note\">' || CASE version "
    + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in NOTES.items() if k) + f" ELSE {lit(NOTES[''])} END || '</p></aside>' AS html FROM refs, versions",
    "set_union_materials": "SELECT conv_id, turn, 0::BIGINT AS part FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn, 1 FROM conversations WHERE role = 'user' UNION ALL (SELECT conv_id, turn, 2 FROM conversations ORDER BY conv_id, turn LIMIT 1)",
    "set_union_review": f"SELECT doc_id, generate_subscripts(items, 1) AS ord, unnest(items) AS item FROM (SELECT d.doc_id, list_concat([{', '.join(map(lit, LATIN.flags))}], coalesce(r.items, [])) AS items FROM documents d LEFT JOIN (SELECT conv_id, list(text ORDER BY turn) AS items FROM conversations WHERE role = 'user' GROUP BY conv_id) r ON r.conv_id = d.doc_id)",
    "out_side": q(resources(), "scoped AS (SELECT *, count(*) FILTER (chunk_id = 'c02') OVER w AS here, row_number() OVER (w ORDER BY ord) AS n FROM resources WINDOW w AS (PARTITION BY lesson_id, kind))", "SELECT lesson_id, kind, row_number() OVER (PARTITION BY lesson_id, kind ORDER BY ord) AS place, upper(chunk_id) AS label, title FROM scoped WHERE CASE WHEN here > 0 THEN chunk_id = 'c02' ELSE n <= 3 END"),
    "nav_sibling_unknown": f"SELECT a.doc_id, s.prev_id, s.next_id FROM (SELECT c_custkey * 3 AS doc_id FROM customer) a JOIN ({_SIBLINGS}) s ON s.doc_id = CASE WHEN a.doc_id IN (SELECT doc_id FROM documents) THEN a.doc_id ELSE (SELECT min(doc_id) FROM documents) END",
    "join_lesson_fallback": "WITH first AS (SELECT * FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels)) SELECT d.doc_id, coalesce(l.quality, f.quality)::BIGINT AS quality, coalesce(l.toxic, f.toxic)::BIGINT AS toxic, l.doc_id IS NOT NULL AS known FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id CROSS JOIN first f",
    "out_sample_html": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.digest(), L.STUDY_POINTS, L.OUTLINE_POINTS, L.RAW, L.CLEAN, L.HTML_DIGEST, L.HTML_STUDY, L.HTML_OUTLINE,
        "SELECT s.doc_id, md5(coalesce(r.raw, '')) AS chunks, " + ", ".join(f"md5(coalesce({v}.html, '')) AS {v}" for v in report.VERSIONS) + " FROM stats s LEFT JOIN (SELECT h.doc_id, string_agg(h.chunk_id || '|' || c.title || '|' || c.start_para || '|' || c.end_para || '|' || c.raw_chars || '|' || h.html, chr(10) ORDER BY h.chunk_no) AS raw FROM html_raw h JOIN chunks c ON c.doc_id = h.doc_id AND c.chunk_no = h.chunk_no GROUP BY h.doc_id) r ON r.doc_id = s.doc_id "
        + " ".join(f"LEFT JOIN ({L.whole(f'html_{v}')}) {v} ON {v}.doc_id = s.doc_id" for v in report.VERSIONS),
    ),
}
ORACLES["join_compare"] = q(L.FOLD, L.RAW, L.CLEAN, "SELECT r.doc_id, r.chunk_id, length(r.html) AS raw_length, md5(c.html) AS version FROM html_raw r JOIN html_clean c ON c.doc_id = r.doc_id AND c.chunk_id = r.chunk_id")
ORACLES["snk_document"] = ORACLES["out_sample_html"]
ORACLES["flt_course_search"] = """SELECT asked, count(*) AS found, sum(p_partkey)::BIGINT AS keys FROM (SELECT DISTINCT unnest([substr(p_name, 3, 6), substr(p_brand, 5, 4), substr(p_name, 1, 2)]) AS asked FROM part)
JOIN part ON asked <> '' AND (contains(lower(p_name), lower(asked)) OR contains(lower(p_brand), lower(asked))) GROUP BY asked"""
ORACLES["src_docx_files"] = q(L.LINES, "SELECT doc_id, count(*) AS paragraphs, sum(length(raw))::BIGINT AS chars FROM paras GROUP BY doc_id")
_COMPARE = "LEFT JOIN html_raw a ON a.doc_id = s.doc_id AND a.chunk_id = '{0}' LEFT JOIN html_raw f ON f.doc_id = s.doc_id AND f.chunk_no = 1 LEFT JOIN {1} o ON o.doc_id = s.doc_id AND o.chunk_id = '{0}' LEFT JOIN ({2}) w ON w.doc_id = s.doc_id"
_EVERY = "every AS (" + " UNION ALL ".join(f"SELECT doc_id, '{v}' AS version, {text_length('html')} AS chars FROM ({L.whole(f'html_{v}')})" for v in report.VERSIONS) + ")"
_BY_LANG = lambda table, value: "CASE lang " + " ".join(f"WHEN {lit(k)} THEN {lit(value(v))}" for k, v in table.items() if k) + f" ELSE {lit(value(table['']))} END"
ORACLES |= {
    "join_lesson_active": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.digest(), L.STUDY_POINTS, L.HTML_DIGEST, L.HTML_STUDY,
        "base AS (SELECT d.doc_id, source, lang, string_split(text, chr(10))[1] AS study, CASE WHEN lang = 'en' THEN source ELSE '' END AS digest, r.items FROM documents d LEFT JOIN (SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS items FROM conversations WHERE role = 'system' GROUP BY conv_id) r ON r.conv_id = d.doc_id)",
        f"SELECT b.doc_id, l.doc_id IS NOT NULL AS has_full, source AS source_file, CASE WHEN l.doc_id IS NULL THEN lang ELSE {_STATS_TEXT} END AS stats_text, CASE WHEN l.doc_id IS NULL THEN lang || '.' ELSE lang || '. 当前页面已接入全文试处理结果：保真清洗、精简整理、学习整理和结构提纲按 ' || chunks || ' 个语义块合并生成。' END AS summary, "
        "md5(CASE WHEN l.doc_id IS NULL THEN study ELSE coalesce(t.html, '') END) AS study, md5(CASE WHEN l.doc_id IS NULL THEN coalesce(nullif(digest, ''), study) ELSE coalesce(g.html, '') END) AS digest, "
        f"concat_ws('|', CASE WHEN l.doc_id IS NOT NULL THEN list_aggregate(CASE WHEN n.doc_id IS NULL THEN {_FLAGS} ELSE list_append({_FLAGS}, {lit(LATIN.noise_flag)}) END, 'string_agg', '|') END, b.items) AS items FROM base b JOIN stats s ON s.doc_id = b.doc_id LEFT JOIN labels l ON l.doc_id = b.doc_id "
        f"LEFT JOIN ({L.whole('html_study')}) t ON t.doc_id = b.doc_id LEFT JOIN ({L.whole('html_digest')}) g ON g.doc_id = b.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM kept WHERE contains(text, {lit(LATIN.noise_text)})) n ON n.doc_id = b.doc_id",
    ),
    "out_detail_compare": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.digest(), L.RAW, L.HTML_DIGEST,
        f"SELECT s.doc_id, d.lang || '｜' || coalesce(d.source, '') AS header, {_STATS_TEXT} AS stats_text, '原始转写稿｜' || upper(coalesce(a.chunk_id, f.chunk_id, 'c02')) AS left_title, md5(coalesce(a.html, f.html, '')) AS left_html, '当前整理版｜精简整理' AS right_title, md5(coalesce(o.html, w.html, '')) AS right_html FROM stats s JOIN documents d ON d.doc_id = s.doc_id " + _COMPARE.format("c02", "html_digest", L.whole("html_digest")),
    ),
    "out_detail_outline": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.OUTLINE_POINTS, L.RAW, L.HTML_OUTLINE,
        "SELECT s.doc_id, '原始转写稿｜' || upper(coalesce(a.chunk_id, f.chunk_id, 'c03')) AS left_title, '当前整理版｜结构提纲' AS right_title, md5(coalesce(o.html, w.html, '')) AS right_html FROM stats s " + _COMPARE.format("c03", "html_outline", L.whole("html_outline")),
    ),
    "out_overview_card": q(
        L.STATS, resources().removeprefix("WITH "), "counts AS (SELECT lesson_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in PRESETS) + " FROM resources WHERE chunk_id = 'c02' GROUP BY lesson_id)",
        f"SELECT d.doc_id, coalesce(lang, '') || '：' || coalesce(source, '') AS heading, {_BY_LANG(SUMMARIES, lambda v: v[0])} AS summary, {_BY_LANG(KEYWORDS, '、'.join)} AS keywords, '原文 ' || printf('%.2f', round(raw_chars / 10000.0, 2)) || ' 万字｜' || chunks || ' 个正文分段' AS process, "
        + ", ".join(f"coalesce({k}, 0) AS {k}" for k in PRESETS) + " FROM documents d JOIN stats s ON s.doc_id = d.doc_id LEFT JOIN counts c ON c.lesson_id = d.doc_id",
    ),
    "out_version_buttons": q(
        L.STATS, L.SENTENCES[len(L.FOLD) + 2 :], L.digest(), L.STUDY_POINTS, L.OUTLINE_POINTS, L.CLEAN, L.HTML_DIGEST, L.HTML_STUDY, L.HTML_OUTLINE, _EVERY,
        "SELECT e.doc_id, version, CASE version " + " ".join(f"WHEN {lit(k)} THEN {lit(v[0])}" for k, v in report.LABELS.items()) + f" END AS label, {format_chars('chars')} || ' · ' || {compression('chars', 'greatest(raw_chars, 1)')} AS shown FROM every e JOIN stats s ON s.doc_id = e.doc_id",
    ),
    "out_assets_tabs": """WITH turns AS (SELECT conv_id AS k1, turn AS k2, role AS type, substr(text, 1, 12) AS title, text AS summary FROM conversations),
every AS (SELECT 'methods' AS tab, '知识点：' || title AS heading, type, summary, CASE WHEN k2 % 4 = 0 THEN title || '|' || type ELSE '来源课程：五上寒假第七讲' END AS details, k1, k2 FROM turns WHERE type = 'user'
UNION ALL SELECT 'materials', '素材：' || title, type, summary, summary, k1, k2 FROM turns WHERE type = 'assistant'
UNION ALL SELECT 'words', '词：' || string_split(text, ' ')[1], 'word', text, array_to_string(string_split(text, ' '), '|'), item_id, 0 FROM benchmark
UNION ALL SELECT 'works', '作品：' || n_name, r_name, lower(n_name), '关联课堂：' || r_name || '|已记字词：' || n_name || '、' || r_name || '|主题：' || lower(r_name), n_nationkey, 0 FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT tab, row_number() OVER (PARTITION BY tab ORDER BY k1, k2) - 1 AS ord, heading, type, summary, details FROM every""",
}
