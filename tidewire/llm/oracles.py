"""SQL that states results of this subpackage independently, for comparison."""

from __future__ import annotations

#: Letters and digits only, in lower case and ordinary width.
_FOLD = ("０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def _letters(x: str) -> str:
    return rf"lower(translate(regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g'), '{_FOLD[0]}', '{_FOLD[1]}'))"


def _windows(source: str, key: str, letters: int) -> str:
    """Every window of ``source`` (key, clean) with its place; long texts are taken in pieces of 500 places."""
    return f"""SELECT {key}, s + o - 1 AS pos, substr(t, o, {letters}) AS w FROM (SELECT {key}, s, t, unnest(range(1, least(500, length(t) - {letters - 1}) + 1)) AS o
        FROM (SELECT {key}, s, substr(clean, s, {500 + letters - 1}) AS t FROM (SELECT {key}, clean, unnest(range(1, length(clean) + 1, 500)) AS s FROM {source})))"""


TOP_MENTIONS = """
    WITH rows AS (SELECT DISTINCT ts_code, publish_date, news_id, coarse_score FROM article_mentions
        WHERE ts_code IS NOT NULL AND publish_date <> '' AND coarse_score IS NOT NULL AND NOT isnan(coarse_score)),
    placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY ts_code, publish_date ORDER BY coarse_score DESC, news_id ASC NULLS LAST) AS INTEGER) AS place FROM rows)
"""

#: The chain by its whole matrix, a hundred steps from an even start.
_WALK = """
    WITH RECURSIVE p AS (SELECT DISTINCT publish_date AS d, ts_code AS i, net_sentiment_factor AS s1, -negative_shock_carry AS s2, attention_factor AS s3, operations_event_state AS s4
        FROM daily_profiles WHERE publish_date IS NOT NULL AND ts_code IS NOT NULL),
    long AS (SELECT d, i, 1 AS s, s1 AS v FROM p UNION ALL SELECT d, i, 2, s2 FROM p UNION ALL SELECT d, i, 3, s3 FROM p UNION ALL SELECT d, i, 4, s4 FROM p),
    scored AS (SELECT * FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
    held AS (SELECT p.d, p.i, count(s.s) AS h, count(*) OVER (PARTITION BY p.d) AS n FROM p LEFT JOIN scored s ON s.d = p.d AND s.i = p.i GROUP BY p.d, p.i),
    jumps AS (SELECT a.d, a.i, b.i AS k, (1.0 / ha.h) * (1.0 / hb.h) / sum(1.0 / hb.h) OVER (PARTITION BY a.d, a.i, a.s) AS c
        FROM scored a JOIN scored b ON a.d = b.d AND a.s = b.s AND b.v >= a.v JOIN held ha ON ha.d = a.d AND ha.i = a.i JOIN held hb ON hb.d = b.d AND hb.i = b.i
        UNION ALL SELECT x.d, x.i, y.i, CASE WHEN x.h = 0 THEN 1.0 / x.n ELSE 0.0 END FROM held x JOIN held y ON x.d = y.d WHERE x.h = 0 OR x.i = y.i),
    chance AS (SELECT d, i, k, sum(c) AS c FROM jumps GROUP BY d, i, k),
    walk AS (SELECT 0 AS step, d, i, CAST(1.0 / n AS DOUBLE) AS m, n FROM held
        UNION ALL SELECT any_value(w.step) + 1, c.d, c.k, 0.85 * sum(w.m * c.c) + 0.15 / any_value(w.n), any_value(w.n) FROM walk w JOIN chance c ON c.d = w.d AND c.i = w.i WHERE w.step < 100 GROUP BY c.d, c.k),
    ranked AS (SELECT d AS publish_date, i AS ts_code, m * n AS stationarity, CAST(row_number() OVER (PARTITION BY d ORDER BY round(m * n, 10) DESC, i) AS INTEGER) AS walk_rank FROM walk WHERE step = 100)
"""

_LEAKS = f"""
    WITH docs AS (SELECT doc_id, text, {_letters('text')} AS clean FROM documents WHERE text IS NOT NULL),
    items AS (SELECT DISTINCT item_id, {_letters('text')} AS clean FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
    dw AS ({_windows('docs', 'doc_id', 60)}), iw AS ({_windows('items', 'item_id', 60)}),
    hits AS (SELECT doc_id, item_id, dw.pos AS d, iw.pos AS i FROM dw JOIN iw ON dw.w = iw.w)
"""

#: All pairs by brute force: eight-letter windows in common, and the letters of the longer text that they cover.
_NEAR = f"""
    WITH RECURSIVE texts AS (SELECT record_no, {_letters("coalesce(title, '') || chr(10) || coalesce(body, '')")} AS clean FROM news_articles WHERE record_no IS NOT NULL),
    w AS (SELECT DISTINCT record_no, pos, hash(w) AS g FROM ({_windows('texts', 'record_no', 8)})),
    whose AS (SELECT DISTINCT record_no, g FROM w),
    met AS (SELECT a.record_no AS a, b.record_no AS b FROM whose a JOIN whose b ON a.g = b.g AND a.record_no < b.record_no GROUP BY 1, 2 HAVING count(*) >= 2),
    sized AS (SELECT m.*, CASE WHEN length(x.clean) >= length(y.clean) THEN m.a ELSE m.b END AS longer, CASE WHEN length(x.clean) >= length(y.clean) THEN m.b ELSE m.a END AS other, greatest(length(x.clean), length(y.clean)) AS n
        FROM met m JOIN texts x ON m.a = x.record_no JOIN texts y ON m.b = y.record_no WHERE 3 * least(length(x.clean), length(y.clean)) >= 2 * greatest(length(x.clean), length(y.clean)) - 24),
    stands AS (SELECT s.a, s.b, s.n, w.pos, lead(w.pos) OVER (PARTITION BY s.a, s.b ORDER BY w.pos) AS next
        FROM sized s JOIN w ON w.record_no = s.longer JOIN whose o ON o.record_no = s.other AND o.g = w.g),
    near AS (SELECT a, b FROM stands GROUP BY a, b, n HAVING sum(least(8, coalesce(next - pos, 8))) * 3 >= 2 * n
        UNION
        SELECT x.record_no, y.record_no FROM texts x JOIN texts y ON x.clean = y.clean AND x.record_no < y.record_no AND x.clean <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _WALK + "SELECT publish_date, ts_code FROM ranked WHERE walk_rank <= 3",
        "p1_ranking": _WALK + "SELECT publish_date, ts_code, CAST(round(round(CAST(stationarity AS DECIMAL(28, 14)), 10), 6) AS DOUBLE) AS stationarity, walk_rank FROM ranked",
        "p2_found": TOP_MENTIONS + "SELECT ts_code, publish_date, news_id FROM placed WHERE place <= 3",
        "p2_top_mentions": TOP_MENTIONS + "SELECT ts_code, publish_date, news_id, coarse_score, place FROM placed WHERE place <= 3",
        "p4_found": """
            WITH p AS (SELECT DISTINCT ts_code, publish_date FROM daily_profiles),
            q AS (SELECT DISTINCT ts_code, trade_date FROM market_prices WHERE trade_date IS NOT NULL AND ts_code IS NOT NULL),
            near AS (SELECT p.ts_code, p.publish_date, q.trade_date, row_number() OVER (PARTITION BY p.ts_code, p.publish_date
                ORDER BY abs(q.trade_date - TRY_CAST(p.publish_date AS DATE)), q.trade_date DESC) AS n
                FROM p JOIN q ON p.ts_code = q.ts_code AND abs(q.trade_date - TRY_CAST(p.publish_date AS DATE)) <= 3)
            SELECT ts_code, publish_date, strftime(trade_date, '%Y-%m-%d') AS trade_date FROM near WHERE n = 1
        """,
        "p6_found": _NEAR + "SELECT a AS record_a, b AS record_b FROM near",
        "p6_groups": _NEAR + """,
            both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
            reach AS (SELECT record_no AS v, record_no AS u FROM texts WHERE clean <> '' UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON e.a = r.u)
            SELECT v AS record_no, min(u) AS group_id FROM reach GROUP BY v
        """,
        "p8_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM hits",
        "p8_leaked_items": _LEAKS + """,
            runs AS (SELECT doc_id, item_id, count(*) + 59 AS n FROM (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, d - i ORDER BY d) AS island FROM hits) GROUP BY doc_id, item_id, d - i, island),
            cover AS (SELECT doc_id, item_id, sum(least(60, coalesce(next - i, 60))) AS n
                FROM (SELECT doc_id, item_id, i, lead(i) OVER (PARTITION BY doc_id, item_id ORDER BY i) AS next FROM (SELECT DISTINCT doc_id, item_id, i FROM hits)) GROUP BY doc_id, item_id),
            best AS (SELECT item_id, max(n) AS longest FROM runs GROUP BY item_id)
            SELECT c.item_id, CAST(count(*) AS BIGINT) AS documents, CAST(any_value(b.longest) AS BIGINT) AS longest, max(c.n / CAST(length(i.clean) AS DOUBLE)) AS most_of_item
            FROM cover c JOIN best b ON b.item_id = c.item_id JOIN items i ON i.item_id = c.item_id GROUP BY c.item_id
        """,
        "p8_cleaned": _LEAKS + r""",
            places AS (SELECT DISTINCT doc_id, d FROM hits),
            marked AS (SELECT *, CASE WHEN d > lag(d) OVER (PARTITION BY doc_id ORDER BY d) + 60 THEN 1 ELSE 0 END AS fresh FROM places),
            spans AS (SELECT doc_id, min(d) AS s, max(d) + 59 AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY d) AS island FROM marked) GROUP BY doc_id, island),
            shares AS (SELECT s.doc_id, count(*) AS spans, sum(e - s + 1) / CAST(any_value(length(clean)) AS DOUBLE) AS share FROM spans s JOIN docs ON docs.doc_id = s.doc_id GROUP BY s.doc_id),
            letters AS (SELECT doc_id, p, letter, sum(CASE WHEN regexp_matches(letter, '[\p{L}\p{N}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS nth, regexp_matches(letter, '[\p{L}\p{N}]') AS counts
                FROM (SELECT doc_id, s + o - 1 AS p, substr(t, o, 1) AS letter FROM (SELECT doc_id, s, t, unnest(range(1, length(t) + 1)) AS o FROM (SELECT doc_id, s, substr(text, s, 500) AS t
                    FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1, 500)) AS s FROM docs WHERE doc_id IN (SELECT doc_id FROM shares WHERE share <= 0.5)))))),
            gone AS (SELECT DISTINCT l.doc_id, l.p FROM letters l JOIN spans s ON l.doc_id = s.doc_id AND l.nth >= s.s AND (l.nth < s.e OR (l.nth = s.e AND l.counts))),
            kept AS (SELECT l.doc_id, string_agg(l.letter, '' ORDER BY l.p) AS clean_text FROM letters l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id)
            SELECT h.doc_id, CASE WHEN h.share <= 0.5 THEN coalesce(k.clean_text, '') END AS clean_text, CAST(h.spans AS INTEGER) AS spans,
                CAST(length(docs.text) - length(coalesce(CASE WHEN h.share <= 0.5 THEN k.clean_text END, '')) AS BIGINT) AS removed_chars, h.share AS doc_share
            FROM shares h JOIN docs ON docs.doc_id = h.doc_id LEFT JOIN kept k ON k.doc_id = h.doc_id
        """,
    }
