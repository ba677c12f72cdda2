"""The named queries again, as plain SQL over the same tables.

Written from the definitions, not from the plans: white space is spelled out,
entropy is the textbook sum over a histogram, and rules are joined.
"""

from __future__ import annotations

from leaksieve.model import DEFAULT_EXEMPT
from leaksieve.operators.languages import EXTENSIONS
from leaksieve.operators.masking import MARKER
from leaksieve.plans import catalog as c
from leaksieve.sources.ignorefile import ADDED_NOTE

_WS = r"[\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_DOC_PATH = """source||'/'||lang||'/d'||CAST(doc_id AS VARCHAR)||'/'||
  CASE doc_id % 25 WHEN 0 THEN 'go.sum' WHEN 1 THEN 'LICENSE' WHEN 2 THEN 'LICENSE-MIT'
    WHEN 3 THEN 'x.secret' WHEN 4 THEN 'keep.secret' WHEN 5 THEN '.git/obj' WHEN 6 THEN '.env'
    ELSE 'doc.'||CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'go' WHEN 2 THEN 'js'
                                 WHEN 3 THEN 'md' ELSE 'bin' END END"""

DOCS = f"""docs AS (
  SELECT doc_id, lang, source, {_DOC_PATH} AS path, strlen(text) AS size,
         CASE WHEN doc_id % 13 = 0 THEN 493 ELSE 420 END AS mode, text
  FROM documents)"""
PAGES = """webs AS (
  SELECT 'pages/'||CAST(page_id AS VARCHAR)||'.html' AS path, strlen(html) AS size, html AS text FROM pages)"""
CHATS = """chats AS (
  SELECT 'chat/'||CAST(conv_id AS VARCHAR)||'/'||CAST(turn AS VARCHAR)||'.txt' AS path,
         strlen(text) AS size, text
  FROM conversations)"""
SOURCES = f"{DOCS}, {PAGES}, {CHATS}"


def _lines(source: str, columns: str = "path") -> str:
    """Lines of a relation; the piece after a final line feed is none."""
    return f"""(
    SELECT {columns}, line_no, regexp_replace(line, '\\r$', '') AS line FROM (
      SELECT {columns}, unnest(pieces) AS line, generate_subscripts(pieces, 1) AS line_no, len(pieces) AS n
      FROM (SELECT *, string_split(text, chr(10)) AS pieces FROM {source}))
    WHERE NOT (line_no = n AND line = ''))"""


def _tokens(source: str, columns: str = "path") -> str:
    return f"""(
    SELECT {columns}, line_no, unnest(parts) AS token, generate_subscripts(parts, 1) AS col
    FROM (SELECT *, list_filter(string_split_regex(line, {_quote(_WS)}), lambda x: x <> '') AS parts
          FROM {_lines(source, columns)}))"""


def _entropy_of(symbols: str, length: str) -> str:
    share = f"(n / {length})"
    return (
        f"(coalesce(list_sum(list_transform(map_values(list_aggregate({symbols}, 'histogram')), "
        f"lambda n: -({share} * log2({share})))), 0.0) + 0.0)"
    )


def _short(text: str) -> str:
    return _entropy_of(f"string_split({text}, '')", f"strlen({text})")


def _standard(text: str) -> str:
    return _entropy_of(f"string_split({text}, '')", f"length({text})")


def _long(text: str) -> str:
    return _entropy_of(f"regexp_extract_all(hex({text}), '..')", f"strlen({text})")


def _entropy(text: str) -> str:
    return f"CASE WHEN strlen({text}) < 256 THEN {_short(text)} ELSE {_long(text)} END"


def _four(value: str) -> str:
    return f"printf('%.4f', round({value}, 9))"


def _above(limit: float, value: str = "e") -> str:
    return f"(round({value}, 9) > {limit})"


_CLASSES = " + ".join(
    f"CAST(regexp_matches(token, '{pattern}') AS INTEGER)" for pattern in ("[0-9]", "[A-Z]", "[a-z]", "[^a-zA-Z0-9]")
)
_COMPLEX = "(strlen(token) >= 15 AND classes >= 3)"


def _scored(source: str, columns: str = "path") -> str:
    """Tokens with entropy ``e`` and class count."""
    return f"(SELECT *, {_entropy('token')} AS e, {_CLASSES} AS classes FROM {_tokens(source, columns)})"


def _rule(header: str, rules: dict[str, str] = c.RULES) -> str:
    return f"regexp_matches(token, {_quote(rules[header])})"


def _value(header: str, rules: dict[str, str] = c.RULES) -> str:
    return f"regexp_extract(token, {_quote(rules[header])})"


def _found(source: str, condition: str, *evidence: str, columns: str = "path") -> str:
    picks = "".join(f", {item}" for item in evidence)
    return (
        f"SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, token{picks} "
        f"FROM {_scored(source, columns)} WHERE {condition}"
    )


_E = f"{_four('e')} AS entropy"
_C = "CAST(classes AS VARCHAR) AS complexity"
_PROSE = f"({_COMPLEX} OR {_above(c.PROSE_LIMIT)})"
_IF_C = f"CASE WHEN {_COMPLEX} THEN CAST(classes AS VARCHAR) END AS complexity"


def _if_e(limit: float) -> str:
    return f"CASE WHEN {_above(limit)} THEN {_four('e')} END AS entropy"


def _if_rule(header: str) -> str:
    return f"CASE WHEN {_rule(header)} THEN {_value(header)} END AS {header}"


def _exempt_name(names: tuple[str, ...]) -> str:
    return f"regexp_extract(path, '[^/]*$') IN ({', '.join(map(_quote, names))})"


def _exempt_path(names: tuple[str, ...]) -> str:
    return f"""EXISTS (SELECT 1 FROM (SELECT unnest([{', '.join(map(_quote, names))}]) AS x)
      WHERE contains(path, '/'||x) OR starts_with(path, x))"""


_EXECUTABLE = "(mode & 73) <> 0"
# Last match wins over (idx, regex, negated).
_IGNORED = r"""path IN (SELECT path FROM (
    SELECT path, arg_max(negated, idx) AS back FROM docs
    JOIN (VALUES (1, '(^|/)[^/]*\.secret$', false), (2, '(^|/)keep\.secret$', true)) AS r(idx, regex, negated)
      ON regexp_matches(path, regex)
    GROUP BY path) WHERE NOT back)"""

_BEFORE = """before AS (
  SELECT path, text FROM (SELECT path, CASE WHEN lang = 'de' THEN text||' old' ELSE text END AS text, source FROM docs)
  WHERE source <> 'src3' UNION ALL SELECT path, text FROM chats)"""
_STATUS = """(
  SELECT coalesce(b.path, d.path) AS path,
         CASE WHEN b.path IS NULL THEN 'untracked' WHEN d.path IS NULL THEN 'deleted'
              WHEN b.text <> d.text THEN 'modified' END AS status
  FROM before b FULL OUTER JOIN docs d ON b.path = d.path)"""


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join((SOURCES, *more)) + "\n" + body


def _hits_text(inner: str) -> str:
    return f"""SELECT path, CAST(count(*) AS INTEGER) AS n_hits,
      string_agg(line_no||':'||col||':'||token, chr(10) ORDER BY line_no, col) AS hits
      FROM ({inner}) GROUP BY path"""


def _in_tree(inner: str) -> str:
    """The same with the paths that the documents have in a tree: a thousand share a folder."""
    number = r"regexp_extract(path, '/d(\d+)/', 1)"
    return rf"""SELECT * REPLACE (regexp_replace(path, '/d\d+/', '/d'||CAST(CAST({number} AS BIGINT) // 1000 AS VARCHAR)||'/')||'~'||{number} AS path)
      FROM ({inner})"""


_LITERAL = r'''"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`'''
_MASKED = f"(regexp_matches(token, {_quote(c.RULES['sha1'])}) OR regexp_matches(token, {_quote(c.RULES['email'])}))"


def _masking(condition: str) -> str:
    """Every text with the lines that hold such a token replaced."""
    return f"""
      SELECT d.path, CAST(count(h.line_no) AS INTEGER) AS n_masked,
             string_agg(CASE WHEN h.line_no IS NULL THEN l.line ELSE {_quote(MARKER)} END, chr(10)
                        ORDER BY l.line_no) AS text
      FROM docs d
      JOIN (SELECT path, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM docs) l ON l.path = d.path
      LEFT JOIN (SELECT DISTINCT path, line_no FROM {_scored('docs')} WHERE {condition}) h
        ON h.path = l.path AND h.line_no = l.line_no
      GROUP BY d.path"""


def _clean(negate: str, condition: str) -> str:
    return f"""SELECT path, size FROM docs WHERE path {negate} IN
      (SELECT path FROM {_scored('docs')} WHERE {condition})"""


# The pieces of four grammar families in the dialect of plain SQL: no look-ahead, shortest matches instead.
_UNIT_WORD = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[ \t\r\n\f\x0B]+|."
_UNIT_STRINGS = r"""\"(?:[^\"\n\\]|\\.)*\"|'(?:[^'\n\\]|\\.)*'"""
_UNIT_C = r"//[^\n]*|/\*.*?(?:\*/|\z)"
_UNIT_PIECES = {
    "python": r"#[^\n]*|" + "|".join("[A-Za-z]{0,2}" + s for s in (r'"""(?:[^\\]|\\.)*?"""', r"'''(?:[^\\]|\\.)*?'''", *_UNIT_STRINGS.split("|'", 1))).replace("[A-Za-z]{0,2}(?:[^'", "[A-Za-z]{0,2}'(?:[^'"),
    "go": f"{_UNIT_C}|{_UNIT_STRINGS}|`[^`]*`",
    "javascript": _UNIT_C + "|" + _UNIT_STRINGS + r"|`(?:[^`\\]|\\.)*`",
    "html": r"""<!--.*?(?:-->|\z)|=[ \t\r\n]*"[^"]*"|=[ \t\r\n]*'[^']*'|>[^<]+""",
}


def _units() -> str:
    """Rows (path, language, line_no, byte_col, kind, token) of all units."""
    cut = " ".join(f"WHEN '{n}' THEN regexp_extract_all(text, {_quote('(?s)' + p + '|' + _UNIT_WORD)})" for n, p in _UNIT_PIECES.items())
    open_ = """CASE WHEN kind <> 'string' THEN '' WHEN language = 'html' THEN regexp_extract(piece, '^(?:=[ \\t\\r\\n]*["'']|>)')
        ELSE regexp_extract(piece, '^[A-Za-z]{0,2}(?:\"\"\"|\'\'\'\'\'\'|["''`])') END"""
    return f"""(SELECT path, language, CAST(length(ahead) - length(replace(ahead, chr(10), '')) + 1 AS INTEGER) AS line_no,
        CAST(strlen(string_split(ahead, chr(10))[-1]) + strlen(opening) + 1 AS INTEGER) AS byte_col, kind,
        substr(piece, 1 + length(opening), length(piece) - length(opening) - CASE WHEN opening IN ('', '>') THEN 0 WHEN right(opening, 3) IN ('\"\"\"', '''''''') THEN 3 ELSE 1 END) AS token
      FROM (SELECT *, {open_} AS opening, array_to_string(cut[1:n - 1], '') AS ahead FROM (
        SELECT *, CASE WHEN regexp_full_match(piece, '[0-9A-Za-z_\\x{{80}}-\\x{{10FFFF}}]+') THEN 'word'
            WHEN length(piece) < 2 OR regexp_full_match(piece, '[ \\t\\r\\n\\f\\x0B]+') THEN NULL
            WHEN language = 'python' AND piece[1] = '#' OR language IN ('go', 'javascript') AND piece[1] = '/' OR language = 'html' AND piece[1] = '<' THEN 'comment'
            ELSE 'string' END AS kind
        FROM (SELECT path, language, cut, unnest(cut) AS piece, generate_subscripts(cut, 1) AS n
              FROM (SELECT *, CASE language {cut} END AS cut FROM typed))))
      WHERE kind IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    loose, prose, page = _above(c.LOOSE_LIMIT), _above(c.PROSE_LIMIT), _above(c.PAGE_LIMIT)
    exempt_more = (*DEFAULT_EXEMPT, *c.EXTRA_EXEMPT)
    is_exempt = f"({_exempt_name(DEFAULT_EXEMPT)} OR {_exempt_path(DEFAULT_EXEMPT)})"
    extensions = ", ".join(f"({_quote(ext)}, {_quote(name)})" for ext, name in EXTENSIONS.items())
    capped = f"(SELECT * FROM docs WHERE size <= {c.MAX_SIZE})"
    prose_hits = _found("docs", _PROSE, _IF_C, _if_e(c.PROSE_LIMIT))
    rules = " UNION ALL ".join(
        f"SELECT path, line_no, col, {_quote(header)} AS header, {_value(header)} AS value FROM all_tokens WHERE {_rule(header)}"
        for header in c.RULES
    )
    page_evidence = (
        f"{_value('attribute', c.PAGE_RULES)} AS attribute",
        f"{_value('number', c.PAGE_RULES)} AS number",
    )
    page_rules = f"{_rule('attribute', c.PAGE_RULES)} AND {_rule('number', c.PAGE_RULES)} AND {_COMPLEX}"
    detect = f"({' OR '.join(_rule(header) for header in c.RULES)} OR ({_COMPLEX} AND {prose}))"
    detect_evidence = (
        *(_if_rule(header) for header in c.RULES),
        f"CASE WHEN {_COMPLEX} AND {prose} THEN CAST(classes AS VARCHAR) END AS complexity",
        f"CASE WHEN {_COMPLEX} AND {prose} THEN {_four('e')} END AS entropy",
    )
    scanned = _found("docs", loose, _E)
    return {
        "files_manifest": _with("SELECT path, size, mode FROM docs"),
        "scan_file_list": _with(
            f"SELECT * FROM ({_found(capped, loose, _E)}) WHERE path IN "
            "(SELECT path FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"
        ),
        "changed_files": _with(f"SELECT * FROM {_STATUS} WHERE status IN ('untracked', 'modified')", _BEFORE),
        "snapshot_status": _with(f"SELECT * FROM {_STATUS} WHERE status IS NOT NULL", _BEFORE),
        "scan_changed": _with(
            f"SELECT * FROM ({scanned}) WHERE path IN "
            f"(SELECT path FROM {_STATUS} WHERE status IN ('untracked', 'modified'))",
            _BEFORE,
        ),
        "report_rows": _with(
            f"""SELECT path, string_agg(token, chr(10) ORDER BY line_no, col) AS lines,
              string_agg(line_no, ',' ORDER BY line_no, col) AS indexes,
              string_agg(col, ',' ORDER BY line_no, col) AS columns,
              string_agg(entropy, ',' ORDER BY line_no, col) AS extracted
              FROM ({_found('docs', prose, _E)}) GROUP BY path"""
        ),
        "ignore_list": _with(f"SELECT DISTINCT path FROM ({prose_hits})"),
        "merge_ignore_rules": _with(
            f"""SELECT CAST(doc_id AS INTEGER) AS line_no, 0 AS part, '  '||path||chr(9)||' ' AS line,
                     '' AS entry
              FROM docs WHERE path IN (SELECT path FROM scored WHERE {_COMPLEX})
              UNION ALL
              SELECT CAST(-1 AS INTEGER), part, CASE part WHEN 0 THEN {_quote(ADDED_NOTE)} ELSE path END, path
              FROM (SELECT DISTINCT path FROM scored WHERE {_PROSE}), (VALUES (0), (1)) AS p(part)
              WHERE path NOT IN (SELECT path FROM scored WHERE {_COMPLEX})""",
            f"scored AS {_scored('docs')}",
        ),
        "exempt_basename": _with(f"SELECT path, size FROM docs WHERE NOT {_exempt_name(DEFAULT_EXEMPT)}"),
        "exempt_path": _with(f"SELECT path, size FROM docs WHERE NOT {_exempt_path(DEFAULT_EXEMPT)}"),
        "exempt_extended": _with(
            f"SELECT path, size FROM docs WHERE NOT ({_exempt_name(exempt_more)} OR {_exempt_path(exempt_more)})"
        ),
        "ignore_rules": _with(f"SELECT path, size FROM docs WHERE NOT ({_IGNORED})"),
        "non_executable": _with(f"SELECT path, size FROM docs WHERE NOT ({_EXECUTABLE})"),
        "size_cap": _with("SELECT path, size FROM docs WHERE size <= 500"),
        "eligible_files": _with(
            f"SELECT path, size FROM docs WHERE size <= {c.MAX_SIZE} AND NOT ({_EXECUTABLE}) "
            f"AND NOT {is_exempt} AND NOT ({_IGNORED})"
        ),
        "scan_eligible": _with(
            f"SELECT * FROM ({_found('docs', prose, _E)}) WHERE path IN (SELECT path FROM docs "
            f"WHERE size <= 1048576 AND NOT ({_EXECUTABLE}) AND NOT {is_exempt} AND NOT ({_IGNORED}))"
        ),
        "lines": _with(f"SELECT path, CAST(line_no AS INTEGER) AS line_no, line FROM {_lines('docs')}"),
        "fields_per_line": _with(
            f"""SELECT path, CAST(line_no AS INTEGER) AS line_no,
              CAST(len(list_filter(string_split_regex(line, {_quote(_WS)}), lambda x: x <> '')) AS INTEGER) AS n_fields
              FROM {_lines('docs')}"""
        ),
        "token_totals": _with(
            f"""SELECT path, count(*) AS n_tokens, CAST(sum(col) AS BIGINT) AS sum_col,
              CAST(max(line_no) AS INTEGER) AS last_line, CAST(sum(strlen(token)) AS BIGINT) AS n_bytes
              FROM (SELECT * FROM {_tokens('docs')} UNION ALL SELECT * FROM {_tokens('webs')}) GROUP BY path"""
        ),
        "token_scan": _with(scanned),
        "long_line_cutoff": _with(
            f"""SELECT f.* FROM ({scanned}) f LEFT JOIN
              (SELECT path, min(line_no) AS cut FROM {_lines('docs')}
               WHERE strlen(line) >= {c.LINE_LIMIT} GROUP BY path) l USING (path)
              WHERE cut IS NULL OR line_no < cut"""
        ),
        "literal_scan": _with(
            f"""SELECT path, language, line_no, unit_no, byte_col, token, {_four('e')} AS entropy FROM (
                SELECT *, {_entropy('token')} AS e FROM (
                  SELECT path, 'html' AS language, CAST(line_no AS INTEGER) AS line_no,
                         CAST(unit_no AS INTEGER) AS unit_no, substr(quoted, 2, length(quoted) - 2) AS token,
                         CAST(strlen(array_to_string(between[1:unit_no], '')) + strlen(array_to_string(units[1:unit_no - 1], '')) + 1
                              AS INTEGER) AS byte_col
                  FROM (SELECT path, line_no, units, between, unnest(units) AS quoted, generate_subscripts(units, 1) AS unit_no
                        FROM (SELECT *, string_split_regex(line, {_quote(_LITERAL)}) AS between, regexp_extract_all(line, {_quote(_LITERAL)}) AS units
                              FROM {_lines('webs')}))))
              WHERE {prose}"""
        ),
        "unit_scan": _with(
            f"""SELECT path, language, line_no, byte_col, kind, token, {_IF_C}, {_if_e(c.PROSE_LIMIT)}
              FROM (SELECT *, {_CLASSES} AS classes, {_entropy('token')} AS e FROM units) WHERE {_PROSE}""",
            f"""typed AS (
              SELECT path, language, text FROM (SELECT path, text FROM docs UNION ALL SELECT path, text FROM webs)
              JOIN (VALUES {extensions}) AS known(ext, language) ON regexp_extract(path, '\\.[^./]*$') = ext
              WHERE language IN ({', '.join(map(_quote, _UNIT_PIECES))}))""",
            f"units AS (SELECT * FROM {_units()})",
        ),
        "language_tag": _with(
            f"""SELECT path, language FROM (SELECT path FROM docs UNION ALL SELECT path FROM webs)
              LEFT JOIN (VALUES {extensions}) AS known(ext, language)
              ON ext = regexp_extract(path, '(\\.[^./]*)$', 1)"""
        ),
        "entropy_short": _with(
            f"""SELECT token, {_four(_short('token'))} AS entropy, {_four(_standard('token'))} AS standard
              FROM (SELECT token FROM {_tokens('docs')} UNION SELECT token FROM {_tokens('webs')})
              WHERE strlen(token) < 256"""
        ),
        "entropy_long": _with(
            f"""SELECT path, CAST(line_no AS INTEGER) AS line_no, {_four(_long('line'))} AS entropy
              FROM {_lines('docs')} WHERE strlen(line) >= 256"""
        ),
        "token_entropy": _with(
            f"""SELECT path, CAST(line_no AS INTEGER) AS line_no, {_four(_entropy('line'))} AS entropy
              FROM (SELECT * FROM {_lines('docs')} UNION ALL SELECT * FROM {_lines('chats')})"""
        ),
        "entropy_filter": _with(_found("docs", prose, _E)),
        "complexity_filter": _with(_found("docs", _COMPLEX, _C)),
        "regex_filter": _with(_found("docs", _rule("sha1"), f"{_value('sha1')} AS sha1")),
        "regex_rules_join": _with(
            f"SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, header, value FROM ({rules})",
            f"all_tokens AS (SELECT * FROM {_tokens('docs')} UNION ALL SELECT * FROM {_tokens('webs')})",
        ),
        "rules_table_scan": _with(
            """SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, header,
              regexp_extract(token, pattern) AS value
            FROM doc_tokens JOIN hits USING (token)""",
            f"doc_tokens AS (SELECT * FROM {_tokens('docs')})",
            f"""table_rules AS (
              SELECT 'w'||CAST(doc_id AS VARCHAR) AS header, lower(word) AS word, '(?i)\\b'||word||'[a-z]?' AS pattern
              FROM (SELECT doc_id, regexp_extract(text, '[A-Za-z]{{7,12}}') AS word FROM documents) WHERE word <> ''
              UNION ALL SELECT * FROM (VALUES {', '.join(f"({_quote(h)}, '', {_quote(r)})" for h, r in c.RULES.items())}))""",
            """hits AS (
              SELECT token, header, pattern FROM (SELECT DISTINCT token FROM doc_tokens) t JOIN table_rules r
                ON CASE WHEN contains(lower(t.token), r.word) THEN regexp_matches(t.token, r.pattern) ELSE false END)""",
        ),
        "any_filters": _with(
            _found(
                "docs", f"({_PROSE} OR {_rule('email')})", _IF_C, _if_e(c.PROSE_LIMIT), _if_rule("email")
            )
        ),
        "all_filters": _with(_found("docs", f"{_COMPLEX} AND {loose}", _C, _E)),
        "configured_filters": _with(_found("webs", f"{page_rules} AND {prose}", *page_evidence, _C, _E)),
        "default_scan": _with(
            _found(
                "webs",
                page,
                *(f"CASE WHEN {page_rules} THEN {item.replace(' AS ', ' END AS ')}" for item in page_evidence),
                f"CASE WHEN {page_rules} THEN CAST(classes AS VARCHAR) END AS complexity",
                _E,
            )
        ),
        "detect_any_rule": _with(
            _found("docs", detect, *detect_evidence) + " UNION ALL " + _found("chats", detect, *detect_evidence)
        ),
        "findings_by_file": _with(_hits_text(scanned)),
        "hit_total": _with(f"SELECT CAST(count(*) AS BIGINT) AS freq FROM ({prose_hits})"),
        "scan_gate": _with(
            f"""SELECT 'documents' AS batch, count(*) > 0 AS has_findings FROM {_scored('docs')} WHERE {prose}
              UNION ALL
              SELECT 'conversations', count(*) > 0 FROM {_scored('chats')} WHERE {page}"""
        ),
        "admit_batch": _with(
            f"""SELECT path, size FROM docs WHERE NOT EXISTS (SELECT 1 FROM {_scored('docs')} WHERE {prose})
              UNION ALL
              SELECT path, size FROM chats WHERE NOT EXISTS (SELECT 1 FROM {_scored('chats')} WHERE {page})"""
        ),
        "clean_files": _with(_clean("NOT", _PROSE)),
        "quarantined_files": _with(_clean("", _PROSE)),
        "merge_scans": _with(
            _hits_text(
                f"""SELECT * FROM first WHERE path NOT IN (SELECT path FROM second) UNION ALL SELECT * FROM second"""
            ),
            f"first AS ({_found('docs', loose)})",
            f"second AS ({_found('''(SELECT * FROM docs WHERE lang = 'en')''', prose)})",
        ),
        "report_lines": _with(
            """SELECT path, line_no, col, CAST(0 AS INTEGER) AS part,
                      'Line '||line_no||' (Col '||col||'): '||token AS message FROM hits
              UNION ALL
              SELECT path, line_no, col, CAST(row_number() OVER (PARTITION BY path, line_no, col ORDER BY key) AS INTEGER),
                     '  '||key||': '||value
              FROM (SELECT *, 'complexity' AS key, complexity AS value FROM hits WHERE complexity IS NOT NULL
                    UNION ALL SELECT *, 'entropy', entropy FROM hits WHERE entropy IS NOT NULL)""",
            f"hits AS ({prose_hits})",
        ),
        "report_meta": _with(
            f"""SELECT {_quote(c.TIMESTAMP)} AS timestamp, {_quote(c.AUTHOR)} AS author,
              CAST(count(*) AS BIGINT) AS freq FROM ({prose_hits})"""
        ),
        "mask_lines": _with(_masking(_MASKED)),
        "mask_reported": _with(f"SELECT path, text FROM ({_masking(prose)}) WHERE n_masked > 0"),
        "restore_lines": _with("SELECT path, text FROM docs"),
        "scan_pages": _with(_found("webs", f"({_COMPLEX} OR {page})", _IF_C, _if_e(c.PAGE_LIMIT))),
        "scan_conversations": _with(_found("chats", loose, _E)),
        "stream_scan": _with(scanned),
        "stream_folder_scan": _with(_in_tree(f"SELECT * FROM ({scanned})")),
        "folder_scan": _with(_in_tree(_hits_text(
            f"SELECT * FROM ({scanned}) WHERE path IN "
            f"(SELECT path FROM docs WHERE size <= {c.TREE_SIZE} AND NOT ({_EXECUTABLE}) AND NOT {is_exempt})"
        ))),
        "stream_gate": _with(
            f"""SELECT path, size, CASE WHEN path IN (SELECT path FROM {_scored('docs')} WHERE {_PROSE})
                                   THEN 'quarantined' ELSE 'clean' END AS verdict FROM docs"""
        ),
        "scan_bytes": _with(
            f"""SELECT path, CAST(line_no AS INTEGER) AS line_no, CAST(col AS INTEGER) AS col, read AS token,
              CASE WHEN size >= 15 AND classes >= 3 THEN CAST(classes AS VARCHAR) END AS complexity, {_if_e(c.PROSE_LIMIT)}
              FROM (SELECT *, {_CLASSES} AS classes, CASE WHEN size < 256 THEN {_entropy_of("string_split(read, '')", 'size')}
                  ELSE {_entropy_of("list_filter(regexp_extract_all(hex(token), '..'), lambda x: x <> 'C3')", 'size')} END AS e
                FROM (SELECT *, regexp_replace(token, '[\u00c0-\u00ff]', chr(65533), 'g') AS read,
                    strlen(token) - length(regexp_replace(token, '[^\u00c0-\u00ff]', '', 'g')) AS size FROM {_tokens('docs')}))
              WHERE size >= 15 AND classes >= 3 OR {_above(c.PROSE_LIMIT)}"""
        ),
        "stream_batch_gate": _with(
            """SELECT path, size, flagged, CASE WHEN max(flagged) OVER (PARTITION BY batch) THEN 'refused' ELSE 'admitted' END AS verdict FROM judged""",
            f"""judged AS (
              SELECT 1 AS batch, path, size, path IN (SELECT path FROM {_scored('docs')} WHERE {_PROSE}) AS flagged FROM docs
              UNION ALL SELECT 2, path, size, path IN (SELECT path FROM {_scored('chats')} WHERE {page}) FROM chats)""",
        ),
    }
