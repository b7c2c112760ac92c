"""SQL over the raw JSON lines: fields, layouts and the unified table, stated independently for comparison."""

from __future__ import annotations

from tidewire.operators import drift

SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_NAMES = ", ".join(f"('{canonical}', '{path}', {rank})" for canonical, names in drift.ALIASES.items() for rank, path in enumerate([*names, *(f"{w}.{a}" for w in drift.WRAPPERS for a in names)]))

#: Every leaf of every object: its dotted path, type and text (an array's elements joined with blanks).
LEAVES = f"""
    names(meaning, path, rank) AS (VALUES {_NAMES}),
    objects AS (SELECT * FROM raw_records WHERE CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
    tree AS (SELECT o.record_no, o.feed, o.file_no, j.id, j.parent, substr(j.fullkey, 3) AS field, j.type AS type, json_extract_string(j.atom, '$') AS atom FROM objects o, json_tree(o.payload) j),
    elements AS (SELECT record_no, parent, string_agg({_strip('atom')}, ' ' ORDER BY id) FILTER (WHERE {_strip('atom')} <> '') AS joined FROM tree WHERE field LIKE '%]' GROUP BY 1, 2),
    leaves AS (SELECT t.record_no, t.feed, t.file_no, t.id, t.field, CASE t.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind,
        CASE WHEN t.type = 'ARRAY' THEN coalesce(e.joined, '') ELSE {_strip('t.atom')} END AS txt
        FROM tree t LEFT JOIN elements e ON e.record_no = t.record_no AND e.parent = t.id WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.field NOT LIKE '%[%' AND t.id > 0)
"""
_BEST = "best AS (SELECT l.record_no, n.meaning, arg_min(l.txt, n.rank * 100000 + l.id) AS txt FROM leaves l JOIN names n ON n.path = lower(l.field) WHERE l.txt <> '' GROUP BY 1, 2)"
_PICKED = ", ".join(f"max(b.txt) FILTER (WHERE b.meaning = '{c}') AS {c}" for c in drift.ALIASES)
#: What each file holds, and the files of each feed in order.
LAYOUTS = f"""
    {LEAVES}, files AS (SELECT feed, file_no, row_number() OVER (PARTITION BY feed ORDER BY file_no) AS seq FROM (SELECT DISTINCT feed, file_no FROM raw_records WHERE feed IS NOT NULL AND file_no IS NOT NULL)),
    sized AS (SELECT feed, file_no, count(*) AS n FROM objects GROUP BY 1, 2),
    counted AS (SELECT feed, file_no, field, count(*) AS held, count(*) FILTER (WHERE kind = 'string') AS s, count(*) FILTER (WHERE kind = 'number') AS n, count(*) FILTER (WHERE kind = 'boolean') AS b, count(*) FILTER (WHERE kind = 'array') AS a FROM leaves GROUP BY 1, 2, 3),
    has AS (SELECT f.feed, f.seq, f.file_no, c.field, CASE greatest(c.s, c.n, c.b, c.a) WHEN c.s THEN 'string' WHEN c.n THEN 'number' WHEN c.b THEN 'boolean' ELSE 'array' END AS kind,
        coalesce((SELECT any_value(meaning) FROM names WHERE path = lower(c.field)), '=' || c.field) AS meaning
        FROM counted c JOIN sized z ON z.feed = c.feed AND z.file_no = c.file_no JOIN files f ON f.feed = c.feed AND f.file_no = c.file_no WHERE c.held * 10 >= z.n)
"""


def oracle_sql() -> dict[str, str]:
    text = lambda c: f"coalesce({c}, '')"
    return {
        "p7_news": f"""WITH {LEAVES}, {_BEST}, extra AS (SELECT record_no, count(DISTINCT field) AS n FROM leaves l WHERE NOT EXISTS (SELECT 1 FROM names WHERE path = lower(l.field)) GROUP BY 1)
            SELECT o.record_no, o.feed, o.file_no, o.line_no, {_PICKED}, CAST(coalesce(any_value(x.n), 0) AS INTEGER) AS further_fields
            FROM objects o LEFT JOIN best b ON b.record_no = o.record_no LEFT JOIN extra x ON x.record_no = o.record_no GROUP BY o.record_no, o.feed, o.file_no, o.line_no""",
        "ref_p8_raw_records": f"""WITH {LEAVES}, {_BEST}, r AS (SELECT o.record_no, o.raw_source_file, o.line_no, {_PICKED} FROM objects o LEFT JOIN best b ON b.record_no = o.record_no GROUP BY ALL)
            SELECT {', '.join(f'{text(c)} AS {c}' for c in ('id', 'title', 'body', 'publish_time', 'source', 'url'))}, substr({text('publish_time')}, 1, 10) AS publish_date, lower({text('language')}) AS language, raw_source_file, line_no FROM r""",
        "p7_found": f"""WITH {LAYOUTS}, steps AS (SELECT feed, seq, file_no FROM files WHERE seq > 1),
            gone AS (SELECT s.feed, s.file_no, h.field, h.meaning, row_number() OVER (PARTITION BY s.feed, s.seq, h.meaning ORDER BY h.field) AS nth FROM steps s JOIN has h ON h.feed = s.feed AND h.seq = s.seq - 1
                WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.feed = s.feed AND x.seq = s.seq AND x.field = h.field)),
            new AS (SELECT s.feed, s.file_no, h.field, h.meaning, row_number() OVER (PARTITION BY s.feed, s.seq, h.meaning ORDER BY h.field) AS nth FROM steps s JOIN has h ON h.feed = s.feed AND h.seq = s.seq
                WHERE NOT EXISTS (SELECT 1 FROM has x WHERE x.feed = s.feed AND x.seq = s.seq - 1 AND x.field = h.field))
            SELECT coalesce(g.feed, n.feed) AS feed, coalesce(g.file_no, n.file_no) AS file_no, CASE WHEN g.field IS NULL THEN 'added' WHEN n.field IS NULL THEN 'removed' ELSE 'renamed' END AS change, coalesce(g.field, '') AS old_field, coalesce(n.field, '') AS new_field
            FROM gone g FULL JOIN new n ON n.feed = g.feed AND n.file_no = g.file_no AND n.meaning = g.meaning AND n.nth = g.nth
            UNION ALL SELECT s.feed, s.file_no, 'retyped', a.field, a.field FROM steps s JOIN has a ON a.feed = s.feed AND a.seq = s.seq JOIN has b ON b.feed = s.feed AND b.seq = s.seq - 1 AND b.field = a.field AND b.kind <> a.kind""",
        "p7_lifespans": f"""WITH {LAYOUTS}, marked AS (SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS fresh FROM has WINDOW w AS (PARTITION BY feed, field ORDER BY seq)),
            islands AS (SELECT *, sum(fresh) OVER (PARTITION BY feed, field ORDER BY seq) AS island FROM marked)
            SELECT feed, field, any_value(kind) AS kind, min(file_no) AS first_file, max(file_no) AS last_file FROM islands GROUP BY feed, field, island""",
        "p7_casts": f"""WITH {LAYOUTS}, kept AS (SELECT DISTINCT field FROM has WHERE meaning LIKE '=%'),
            plan AS (SELECT field, CASE greatest(sum(s), sum(n), sum(b), sum(a)) WHEN sum(s) THEN 'string' WHEN sum(n) THEN 'number' WHEN sum(b) THEN 'boolean' ELSE 'array' END AS target FROM counted JOIN kept USING (field) GROUP BY field)
            SELECT l.field, p.target, count(*) AS given, count(*) FILTER (WHERE l.kind <> p.target) AS cast_values,
                count(*) FILTER (WHERE CASE p.target WHEN 'number' THEN TRY_CAST(l.txt AS DOUBLE) IS NULL WHEN 'boolean' THEN TRY_CAST(l.txt AS BOOLEAN) IS NULL ELSE false END) AS failed
            FROM leaves l JOIN plan p ON p.field = l.field GROUP BY 1, 2""",
    }
