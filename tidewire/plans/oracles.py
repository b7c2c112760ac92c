"""SQL that states the same results independently, for comparison."""

from __future__ import annotations

from tidewire.functions import wordlists as W
from tidewire.operators import ranking, validation

SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _text(x: str) -> str:
    return f"coalesce({_strip(x)}, '')"


def _squeeze(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '{SPACE}+', '', 'g'))"


def _r4(x: str) -> str:
    """Decimal rounding, half away from zero, of ten digits to four; DuckDB's own double rounding isn't decimal."""
    return f"CAST(round(CAST({x} AS DECIMAL(28, 10)), 4) AS DOUBLE)"


def _r8(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28, 12)), 8) AS DOUBLE)"


def _num(x: str, default: str = "0.0") -> str:
    return f"coalesce(CASE WHEN isnan({x}) THEN NULL ELSE {x} END, {default})"


def _hits(content: str, values: list[str]) -> str:
    return f"list_filter({_list(values)}, lambda w: contains({content}, w))"


def _weigh(found: str, title: str, inside: float, outside: float) -> str:
    return f"coalesce(list_sum(list_transform({found}, lambda w: CASE WHEN contains({title}, w) THEN {inside}::DOUBLE ELSE {outside}::DOUBLE END)), 0.0)"


BOTH = "coalesce(title, '') || chr(10) || coalesce(body, '')"
LOW = f"lower({BOTH})"
EXCERPT = "coalesce(title, '') || chr(10) || substr(coalesce(body, ''), 1, 1600)"
UNIVERSE = f"""
    universe AS (SELECT {_text('ts_code')} AS ts_code, {_text('name')} AS name, {_text('industry')} AS industry,
        list_concat(regexp_split_to_array(coalesce(aliases, ''), '[|,;；、/]+'), [name]) AS parts FROM stock_universe WHERE {_text('ts_code')} <> '' AND {_text('name')} <> ''),
    listed AS (SELECT ts_code, name, industry, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM universe),
    cleaned AS (SELECT ts_code, name, industry, {_text('part')} AS alias, min(place) AS place FROM listed WHERE {_text('part')} <> '' GROUP BY ALL),
    aliases AS (SELECT *, {_squeeze('alias')} AS squeezed FROM cleaned)
"""
#: Aliases split at bars only, one of each squeezed form, and what the text reads as: one alternation of all, longest first, taken from left to right.
QUARTER = f"""
    listed AS (SELECT ts_code, name, industry, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM (SELECT {_text('ts_code')} AS ts_code, {_text('name')} AS name, {_text('industry')} AS industry,
        list_concat(string_split(coalesce(aliases, ''), '|'), [name]) AS parts FROM stock_universe WHERE {_text('ts_code')} <> '' AND {_text('name')} <> '')),
    aliases AS (SELECT ts_code, name, industry, {_text('part')} AS alias, {_squeeze('part')} AS squeezed FROM listed WHERE length({_squeeze('part')}) >= 2 QUALIFY row_number() OVER (PARTITION BY ts_code, {_squeeze('part')} ORDER BY place) = 1),
    pattern AS (SELECT string_agg(regexp_escape(squeezed), '|' ORDER BY length(squeezed) DESC, squeezed) AS p FROM (SELECT DISTINCT squeezed FROM aliases)),
    read_as AS (SELECT DISTINCT record_no, unnest(regexp_extract_all({_squeeze(EXCERPT)}, p)) AS squeezed FROM news_articles, pattern),
    candidates AS (SELECT DISTINCT r.record_no, a.ts_code, a.squeezed FROM read_as r JOIN aliases a ON a.squeezed = r.squeezed)
"""
MATCHED = f"""
    {UNIVERSE}, texts AS (SELECT record_no, {_squeeze(BOTH)} AS content FROM news_articles),
    found AS (SELECT t.record_no, a.ts_code, a.name, a.industry, a.alias, a.place, a.squeezed FROM texts t JOIN aliases a ON length(a.squeezed) >= 2 AND contains(t.content, a.squeezed)),
    by_stock AS (SELECT record_no, ts_code, name, industry, string_agg(alias, '|' ORDER BY place) AS matched_aliases, list(alias ORDER BY place) AS alias_list, max(length(squeezed)) AS longest, count(*) AS n, max(length(alias)) AS raw FROM found GROUP BY ALL)
"""
COARSE = f"""
    {MATCHED}, scored AS (SELECT *, {_r4('least(1.0::DOUBLE, 0.68::DOUBLE + 0.03::DOUBLE * longest + 0.05::DOUBLE * (n - 1))')} AS coarse_score FROM by_stock),
    coarse AS (SELECT *, CAST(row_number() OVER (PARTITION BY record_no ORDER BY coarse_score DESC, n DESC, raw DESC, ts_code) AS INTEGER) AS candidate_rank FROM scored)
"""
MENTIONS = "m AS (SELECT DISTINCT * EXCLUDE (batch_index) FROM article_mentions)"
USABLE = f"{MENTIONS}, u AS (SELECT * REPLACE (coalesce(stock_name, '') AS stock_name) FROM m WHERE coalesce(publish_date, '') <> '' AND ts_code IS NOT NULL)"


def _event_weight(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{e}' THEN {w}::DOUBLE" for e, w in W.EVENT_WEIGHTS.items()) + f" ELSE {W.OTHER_WEIGHT}::DOUBLE END"


WEIGHT = f"greatest({_num('relevance')}, 0.05) * greatest({_num('confidence')}, 0.05) * greatest({_num('event_importance')}, 0.1) * (0.5 + 0.5 * greatest({_num('sentiment_strength')}, 0.0)) * ({_event_weight('event_type')})"
GROUP = "publish_date, ts_code, stock_name"
BASE = f"""
    {USABLE}, w AS (SELECT *, {WEIGHT} AS weight, {_num('sentiment')} AS s FROM u),
    base AS (SELECT {GROUP}, count(DISTINCT news_id) AS article_count, count(*) AS mention_count,
        {_r4('sum(s * weight) / greatest(sum(weight), 1e-6)')} AS net_sentiment_factor, {_r4('sum(greatest(-s, 0.0) * weight) / greatest(sum(weight), 1e-6)')} AS negative_shock_factor,
        {_r4(f"tanh(ln(1 + count(DISTINCT news_id) + count(*) / 2.0::DOUBLE) * avg({_num('relevance')}) / 2)")} AS attention_factor, {_r4('stddev_pop(s)')} AS sentiment_dispersion_factor,
        {_r4('tanh(count(*) / 3.0::DOUBLE)')} AS event_density_factor, {_r4('avg(coalesce(risk_flag, 0)::DOUBLE)')} AS risk_ratio, {_r4('avg((s > 0.15)::INT::DOUBLE)')} AS positive_ratio,
        {_r4('greatest(0.0, 1 - avg((s > 0.15)::INT::DOUBLE) - avg((s < -0.15)::INT::DOUBLE))')} AS neutral_ratio, {_r4('avg((s < -0.15)::INT::DOUBLE)')} AS negative_ratio,
        {', '.join(_r4(f"sum(CASE WHEN event_type = '{e}' THEN s * weight ELSE 0.0 END) / greatest(sum(weight), 1e-6)") + f' AS {b}_event_factor' for e, b in W.EVENT_FACTORS.items())}
        FROM w GROUP BY {GROUP})
"""


def _ema(x: str, alpha: str) -> str:
    return f"list_reduce(list({x}) OVER past, lambda a, x: a * (1 - {alpha}) + x * {alpha})"


_CARRY = "list_reduce(list_prepend(0.0::DOUBLE, list(negative_shock_factor) OVER past), lambda a, x: 0.65::DOUBLE * a + x)"
_ORDER = "PARTITION BY ts_code ORDER BY publish_date, stock_name"
STATES = f"""
    {BASE}, folded AS (SELECT *, net_sentiment_factor AS x,
        coalesce(net_sentiment_factor - lag(net_sentiment_factor, 1) OVER o, 0.0) AS sentiment_delta_1d, coalesce(net_sentiment_factor - lag(net_sentiment_factor, 3) OVER o, 0.0) AS sentiment_trend_factor,
        coalesce(net_sentiment_factor - avg(net_sentiment_factor) OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0.0) AS sentiment_momentum_factor,
        coalesce(net_sentiment_factor - avg(net_sentiment_factor) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS event_novelty_factor,
        {_ema('net_sentiment_factor', '0.5::DOUBLE')} AS ema3_sentiment_state, {_ema('net_sentiment_factor', '(1.0::DOUBLE / 3)')} AS ema5_sentiment_state, {_CARRY} AS negative_shock_carry,
        {', '.join(_ema(f'{b}_event_factor', '(1.0::DOUBLE / 3)') + f' AS {b}_event_state' for b in W.EVENT_FACTORS.values())}
        FROM base WINDOW o AS ({_ORDER}), past AS ({_ORDER} ROWS UNBOUNDED PRECEDING)),
    states AS (SELECT *, greatest(-1.0, least(1.0, 0.35 * ema3_sentiment_state + 0.10 * ema5_sentiment_state - 0.20 * negative_shock_carry + 0.10 * attention_factor + 0.08 * earnings_event_state + 0.08 * operations_event_state + 0.07 * financing_event_state + 0.05 * market_buzz_event_state - 0.08 * risk_event_state - 0.05 * sentiment_dispersion_factor)) AS state_composite_factor,
        greatest(-1.0, least(1.0, 0.45 * net_sentiment_factor - 0.25 * negative_shock_factor + 0.15 * attention_factor + 0.15 * greatest(-1.0, least(1.0, sentiment_momentum_factor)) - 0.10 * sentiment_dispersion_factor)) AS composite_score FROM folded)
"""
DOMINANT = f"""
    ev AS (SELECT {GROUP}, coalesce(event_type, '') AS event_type, count(*) AS n, min(coalesce(news_id, '')) AS seen FROM u GROUP BY ALL),
    dominant AS (SELECT {GROUP}, event_type AS dominant_event_type FROM ev QUALIFY row_number() OVER (PARTITION BY {GROUP} ORDER BY n DESC, seen, event_type) = 1)
"""
KEYWORDS = f"""
    kw0 AS (SELECT {GROUP}, coalesce(news_id, '') AS id, list_filter(list_transform(string_split(coalesce(keywords, ''), '|'), lambda k: {_strip('k')}), lambda k: k <> '') AS ks FROM u),
    kw1 AS (SELECT {GROUP}, id, unnest(ks) AS word, generate_subscripts(ks, 1) AS place FROM kw0),
    kw2 AS (SELECT {GROUP}, word, count(*) AS n, min({{'id': id, 'place': place}}) AS seen FROM kw1 GROUP BY ALL),
    kw3 AS (SELECT *, row_number() OVER (PARTITION BY {GROUP} ORDER BY n DESC, seen, word) AS r FROM kw2),
    words AS (SELECT {GROUP}, string_agg(word, '|' ORDER BY r) AS top_keywords FROM kw3 WHERE r <= 5 GROUP BY ALL)
"""
LABEL = """concat_ws('-', CASE WHEN attention_factor >= 0.60 THEN '高关注' WHEN attention_factor >= 0.35 THEN '中关注' ELSE '低关注' END,
    CASE WHEN net_sentiment_factor >= 0.20 THEN '偏正面' WHEN net_sentiment_factor <= -0.20 THEN '偏负面' ELSE '中性偏稳' END,
    CASE WHEN round(sentiment_momentum_factor, 10) >= 0.15 THEN '情绪上行' WHEN round(sentiment_momentum_factor, 10) <= -0.15 THEN '情绪走弱' ELSE '趋势平稳' END,
    CASE WHEN negative_shock_factor >= 0.35 OR risk_ratio >= 0.40 THEN '风险升温' ELSE '风险可控' END)"""
LATE = "sentiment_delta_1d sentiment_trend_factor sentiment_momentum_factor ema3_sentiment_state ema5_sentiment_state negative_shock_carry event_novelty_factor".split() + [f"{b}_event_state" for b in W.EVENT_FACTORS.values()] + ["state_composite_factor", "composite_score"]
PROFILES = "p AS (SELECT DISTINCT * EXCLUDE (batch_index) FROM daily_profiles)"
QUOTES = "q AS (SELECT ts_code, trade_date, min({'close': close, 'f1': fwd_return_1d, 'f3': fwd_return_3d, 'f5': fwd_return_5d}) AS v FROM market_prices WHERE trade_date IS NOT NULL AND ts_code IS NOT NULL GROUP BY ALL)"


def _finite(x: str) -> str:
    return f"CASE WHEN isnan({x}::DOUBLE) THEN NULL ELSE {x}::DOUBLE END"


DERIVED = f"""
    {PROFILES}, d AS (SELECT *, greatest(-1.0, least(1.0, least({_num('net_sentiment_factor')}, {_num('ema5_sentiment_state')}))) AS sentiment_confirmation_factor,
        0.30 * greatest(0.0, least(1.0, article_count / 3.0::DOUBLE)) + 0.20 * greatest(0.0, least(1.0, mention_count / 3.0::DOUBLE)) + 0.20 * greatest(0.0, least(1.0, {_num('attention_factor')} / 0.65)) + 0.30 * (1 - greatest(0.0, least(1.0, {_num('sentiment_dispersion_factor')} / 0.8))) AS coverage_reliability_factor FROM p),
    dm AS (SELECT *, greatest(0.7, least(1.0, 0.70 + 0.20 * coverage_reliability_factor + 0.10 * (0.6 * (1 - greatest(0.0, least(1.0, {_num('sentiment_dispersion_factor')} / 0.8))) + 0.4 * greatest(0.0, least(1.0, abs({_num('event_novelty_factor')}) / 0.9))))) AS multiplier FROM d)
"""


def _signals(names: dict[str, int]) -> str:
    parts = []
    for n, direction in names.items():
        v = f"round({_finite(n)} * {direction}, 12)"
        parts.append(f"CASE WHEN {v} IS NULL THEN NULL WHEN min({v}) OVER day = max({v}) OVER day THEN 0.5 ELSE (rank() OVER (PARTITION BY publish_date ORDER BY {v} ASC NULLS LAST) + (count(*) OVER (PARTITION BY publish_date, {v}) - 1) / 2.0::DOUBLE) / count({v}) OVER day END AS sig_{n}")
    return ", ".join(parts)


def _score(factors: list, group: str | None = None) -> str:
    used = [f for f in factors if group is None or f.group == group]
    if not used:
        return "0.0::DOUBLE"
    return "(" + " + ".join(f"coalesce(sig_{f.name}, 0.5) * {f.weight}::DOUBLE" for f in used) + f") / {sum(abs(f.weight) for f in used)!r}::DOUBLE"


def _ranked(name: str, k: int = 5) -> str:
    factors = ranking.preset(name)
    groups = list(dict.fromkeys(f.group for f in factors))
    return f"""
        {DERIVED}, sg AS (SELECT *, {_signals({f.name: f.direction for f in factors})} FROM dm WINDOW day AS (PARTITION BY publish_date)),
        sc AS (SELECT *, {_score(factors)} AS base_ranking_score, {', '.join(f'{_r4(_score(factors, g))} AS {g}_group_score' for g in groups)} FROM sg),
        rs AS (SELECT *, round(0.5 + (base_ranking_score - 0.5) * multiplier, 10) AS ranking_score FROM sc),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY publish_date ORDER BY ranking_score DESC, ts_code) AS INTEGER) AS rank_in_date FROM rs)
    """, groups, k


def _rank_query(name: str) -> str:
    sql, groups, k = _ranked(name)
    return f"WITH {sql} SELECT publish_date, ts_code, {_r8('base_ranking_score')} AS base_ranking_score, {_r8('ranking_score')} AS ranking_score, rank_in_date, CAST(rank_in_date <= {k} AS INTEGER) AS selected_topk, {', '.join(f'{g}_group_score' for g in groups)} FROM ranked"


ASOF = "SELECT l.*, q.trade_date AS anchor, q.v.close AS anchor_close, q.v.f1 AS f1, q.v.f3 AS f3, q.v.f5 AS f5 FROM {left} l ASOF LEFT JOIN q ON l.ts_code = q.ts_code AND TRY_CAST(l.publish_date AS DATE) < q.trade_date"
_OPT = _ranked("optimized")[0]
TOPK = f"""
    {_OPT}, {QUOTES}, panel AS ({ASOF.format(left='ranked')}),
    lng AS (SELECT publish_date, ts_code, ranking_score, rank_in_date <= 5 AS picked, h.horizon AS horizon, CASE WHEN isnan(h.ret) THEN NULL ELSE h.ret END AS ret FROM (SELECT *, unnest([{{'horizon': 1, 'ret': f1}}, {{'horizon': 3, 'ret': f3}}, {{'horizon': 5, 'ret': f5}}]) AS h FROM panel)),
    placed AS (SELECT *, count(*) FILTER (WHERE picked AND ret IS NOT NULL) OVER (PARTITION BY publish_date, horizon) AS k, row_number() OVER (PARTITION BY publish_date, horizon ORDER BY ret IS NULL, ranking_score, ts_code) AS low FROM lng),
    agg AS (SELECT publish_date, horizon, count(DISTINCT ts_code) AS cross_section_size, count(*) FILTER (WHERE picked) AS topk_size, avg(ret) FILTER (WHERE picked) AS t, avg(ret) AS a, avg(ret) FILTER (WHERE low <= k) AS b FROM placed GROUP BY ALL),
    perf AS (SELECT publish_date, horizon, cross_section_size, topk_size, round(t, 10) AS topk_mean_return, round(CASE WHEN t IS NOT NULL THEN a END, 10) AS universe_mean_return, round(t - a, 10) AS topk_excess_return, round(CASE WHEN t IS NOT NULL THEN b END, 10) AS bottomk_mean_return, round(t - b, 10) AS top_bottom_spread FROM agg WHERE topk_size > 0)
"""


def _broad() -> str:
    return f"""
        WITH t AS (SELECT record_no, lower(coalesce(title, '')) AS title, {_hits(LOW, W.STRONG)} AS s, {_hits(LOW, W.WEAK)} AS w, {_hits(LOW, W.EXCLUDE)} AS e FROM news_articles),
        c AS (SELECT *, {_r4(f"{_weigh('s', 'title', 3.0, 2.0)} + {_weigh('w', 'title', 1.5, 1.0)} - {_weigh('e', 'title', 3.0, 2.0)}")} AS score FROM t)
        SELECT record_no, score AS filter_score, (len(s) > 0 OR len(w) >= 2 OR score >= 3) AND NOT (len(e) > 0 AND len(s) = 0 AND score < 4) AS filter_keep,
            array_to_string(s, '|') AS strong_hits, array_to_string(w, '|') AS weak_hits, array_to_string(e, '|') AS exclude_hits FROM c
    """


def _strict() -> str:
    score = " + ".join(f"({_weigh(c, 'title', a, b)}) * {s}" for c, a, b, s in (("s", 3.5, 2.5, 1), ("w", 1.2, 0.8, 1), ("f", 0.8, 0.4, 1), ("e", 3.0, 2.0, -1), ("n", 2.5, 1.5, -1)))
    return f"""
        WITH t AS (SELECT record_no, lower(coalesce(title, '')) AS title, {_hits(LOW, W.STRONG)} AS s, {_hits(LOW, W.WEAK)} AS w, {_hits(LOW, W.COMPANY)} AS f, {_hits(LOW, W.EXCLUDE)} AS e, {_hits(LOW, W.STRICT_EXCLUDE)} AS n FROM news_articles),
        c AS (SELECT *, {_r4(score)} AS score FROM t)
        SELECT record_no, score AS filter_score, ((len(s) > 0 AND score >= 3) OR (len(f) > 0 AND len(w) >= 2 AND score >= 3.5) OR score >= 5) AND NOT (len(n) > 0 AND len(s) = 0 AND score < 6) AS filter_keep,
            array_to_string(s, '|') AS strong_hits, array_to_string(list_concat(w, f), '|') AS weak_hits, array_to_string(list_concat(e, n), '|') AS exclude_hits FROM c
    """


def _any(content: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"contains({content}, '{v}')" for v in values) + ")"


def _rule_mentions() -> str:
    event = "CASE " + " ".join(f"WHEN {_any('c', ws)} THEN '{e}'" for e, ws in W.EVENTS.items()) + f" ELSE '{W.OTHER_EVENT}' END"
    return f"""
        WITH {COARSE}, art AS (SELECT record_no, coalesce(title, '') AS title, {EXCERPT} AS c FROM news_articles),
        h AS (SELECT record_no, title, c, {_hits('c', W.POSITIVE)} AS up, {_hits('c', W.NEGATIVE)} AS down, {_hits('c', W.RISK)} AS risk, {event} AS event_type FROM art),
        s AS (SELECT x.ts_code, x.name, x.alias_list, x.coarse_score, h.*, len(up) + len(down) > 0 AS moved,
            {_r4("greatest(-1.0, least(1.0, 0.18 * len(up) - 0.2 * len(down) + CASE WHEN len(list_filter(x.alias_list, lambda a: contains(title, a))) > 0 THEN 0.08 ELSE 0.0 END))")} AS sentiment FROM coarse x JOIN h ON x.record_no = h.record_no WHERE x.candidate_rank <= 8)
        SELECT record_no, ts_code, name AS stock_name, event_type, sentiment, {_r4('greatest(0.05, least(1.0, abs(sentiment) + 0.08 * moved::INT))')} AS sentiment_strength,
            {_r4('greatest(0.0, least(0.95, 0.55 + 0.10 * len(alias_list) + 0.06 * (moved OR len(risk) > 0)::INT))')} AS confidence, {_r4('greatest(0.0, least(1.0, (coarse_score + 0.75) / 2))')} AS relevance,
            {_r4(f"greatest(0.2, least(1.0, ({_event_weight('event_type')}) / 1.15))")} AS event_importance, CAST(len(risk) > 0 OR event_type = '风险' AS INTEGER) AS risk_flag,
            CASE WHEN {_any('c', W.TREND_UP)} THEN CASE WHEN sentiment >= -0.05 THEN '上升' ELSE '震荡' END WHEN {_any('c', W.TREND_DOWN)} THEN CASE WHEN sentiment <= 0.05 THEN '下降' ELSE '震荡' END WHEN sentiment > 0.15 THEN '上升' WHEN sentiment < -0.15 THEN '下降' ELSE '震荡' END AS trend_signal,
            array_to_string(list_transform(list_filter(list_transform(list_concat(alias_list, up, down, risk), lambda v, i: {{'v': v, 'i': i, 'f': list_position(list_concat(alias_list, up, down, risk), v)}}), lambda z: z.i = z.f)[1:6], lambda z: z.v), '|') AS keywords FROM s
    """


def _time_series() -> str:
    names = list(validation.FACTORS)
    pairs = ", ".join(f"{{'factor': '{n}', 'direction': {validation.FACTORS[n]}, 'x': {_finite(n)}}}" for n in names)
    return f"""
        {PROFILES}, {QUOTES}, panel AS ({ASOF.format(left='p')}),
        l1 AS (SELECT publish_date, ts_code, f1, f3, f5, unnest([{pairs}]) AS f FROM panel),
        l2 AS (SELECT publish_date, ts_code, f.factor AS factor, f.direction AS direction, f.x AS x, unnest([{{'horizon': 1, 'y': f1}}, {{'horizon': 3, 'y': f3}}, {{'horizon': 5, 'y': f5}}]) AS h FROM l1),
        lng AS (SELECT publish_date, ts_code, factor, direction, x, h.horizon AS horizon, {_finite('h.y')} AS y FROM l2 WHERE x IS NOT NULL AND {_finite('h.y')} IS NOT NULL)
    """


def _merged() -> str:
    """One row for each article and stock: weighted means, and lists in the order of weight, event and summary."""
    clamp = lambda x, low: f"greatest({low}::DOUBLE, least(1.0::DOUBLE, {x}))"
    mean = lambda c: f"CASE WHEN sum(w) > 1e-6 THEN sum({_num(c)} * w) / sum(w) ELSE 0.0 END"
    return f"""
        {MENTIONS}, rows AS (SELECT *, concat(stock_name, event_type) AS summary, {WEIGHT} AS w, list_filter(list_transform(string_split(coalesce(keywords, ''), '|'), lambda k: {_strip('k')}), lambda k: k <> '') AS words FROM m WHERE ts_code IS NOT NULL),
        placed AS (SELECT *, row_number() OVER (PARTITION BY news_id, ts_code ORDER BY w DESC, coalesce(event_type, ''), coalesce(summary, ''), words, trend_signal NULLS FIRST, stock_name NULLS FIRST) AS place FROM rows),
        sums AS (SELECT news_id, ts_code, max(stock_name) FILTER (WHERE place = 1) AS stock_name, {', '.join(f"{_r4(clamp(mean(c), low))} AS {c}" for c, low in (('sentiment', '-1.0'), ('sentiment_strength', '0.0'), ('confidence', '0.0'), ('relevance', '0.0')))},
            {_r4(clamp('max(' + _num('event_importance') + ')', '0.0'))} AS event_importance, max((coalesce(risk_flag, 0) <> 0)::INT) AS risk_flag, CAST(count(*) AS INTEGER) AS merged_event_count,
            count(DISTINCT trend_signal) FILTER (WHERE coalesce(trend_signal, '') NOT IN ('', '未知')) AS trends, max(trend_signal) FILTER (WHERE coalesce(trend_signal, '') NOT IN ('', '未知')) AS trend, max(trend_signal) FILTER (WHERE place = 1) AS first_trend
            FROM placed GROUP BY news_id, ts_code),
        by_event AS (SELECT news_id, ts_code, event_type, row_number() OVER (PARTITION BY news_id, ts_code ORDER BY {_r4('sum(w)')} DESC, {_event_weight('event_type')} DESC, event_type NULLS FIRST) AS e FROM placed GROUP BY news_id, ts_code, event_type),
        events AS (SELECT news_id, ts_code, max(event_type) FILTER (WHERE e = 1) AS event_type, coalesce(string_agg(event_type, '|' ORDER BY e), '') AS merged_event_types FROM by_event GROUP BY news_id, ts_code),
        each_word AS (SELECT news_id, ts_code, place, unnest(words) AS word, generate_subscripts(words, 1) AS nth FROM placed),
        first_words AS (SELECT news_id, ts_code, word, row_number() OVER (PARTITION BY news_id, ts_code ORDER BY min(place * 100000 + nth)) AS k FROM each_word GROUP BY news_id, ts_code, word),
        listed_words AS (SELECT news_id, ts_code, string_agg(word, '|' ORDER BY k) AS keywords FROM first_words WHERE k <= 6 GROUP BY news_id, ts_code),
        merged AS (SELECT s.* EXCLUDE (trends, trend, first_trend), e.event_type, e.merged_event_types, CASE WHEN trends = 1 THEN trend WHEN trends > 1 THEN '震荡' ELSE first_trend END AS trend_signal, coalesce(l.keywords, '') AS keywords
            FROM sums s JOIN events e ON e.news_id IS NOT DISTINCT FROM s.news_id AND e.ts_code = s.ts_code LEFT JOIN listed_words l ON l.news_id IS NOT DISTINCT FROM s.news_id AND l.ts_code = s.ts_code)
    """


def _diverse() -> str:
    """Greedy picks by recursion over each group's rows in order: first those with a new event, then the rest."""
    score = " + ".join(f"{_num(c)} * {w}::DOUBLE" for c, w in [("relevance", 0.35), ("confidence", 0.20), ("event_importance", 0.20), ("sentiment_strength", 0.15), ("coarse_score", 0.05)])
    return f"""
        WITH RECURSIVE {MENTIONS}, rows AS (SELECT publish_date, ts_code, news_id, {_r4(score + " + coalesce(merged_event_count, 1.0) * 0.05::DOUBLE")} AS diversity_score, {_num('relevance')} AS rel, {_num('confidence')} AS conf,
            list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(merged_event_types, ''), '|'), lambda k: {_strip('k')}), lambda k: k <> ''))) AS listed, {_text('event_type')} AS single
            FROM m WHERE publish_date IS NOT NULL AND ts_code IS NOT NULL),
        sorted AS (SELECT publish_date, ts_code, news_id, diversity_score, CASE WHEN len(listed) > 0 THEN listed WHEN single <> '' THEN [single] ELSE ['其他'] END AS events,
            row_number() OVER (PARTITION BY publish_date, ts_code ORDER BY diversity_score DESC, rel DESC, conf DESC, coalesce(news_id, '')) AS n FROM rows),
        walk AS (SELECT publish_date, ts_code, n, events AS seen, 1 AS taken, true AS fresh FROM sorted WHERE n = 1
            UNION ALL SELECT s.publish_date, s.ts_code, s.n, CASE WHEN w.taken < 3 AND NOT list_has_all(w.seen, s.events) THEN list_distinct(list_concat(w.seen, s.events)) ELSE w.seen END,
                w.taken + (w.taken < 3 AND NOT list_has_all(w.seen, s.events))::INT, w.taken < 3 AND NOT list_has_all(w.seen, s.events)
            FROM walk w JOIN sorted s ON s.publish_date = w.publish_date AND s.ts_code = w.ts_code AND s.n = w.n + 1),
        ordered AS (SELECT s.*, row_number() OVER (PARTITION BY s.publish_date, s.ts_code ORDER BY w.fresh DESC, s.n) AS pick FROM sorted s JOIN walk w USING (publish_date, ts_code, n))
    """


def _study() -> str:
    """Records with their best match (no stock reaches its quota here), without words of single stocks: none of the listed stocks is in the universe."""
    score = f"CASE WHEN full_name THEN 4.0::DOUBLE WHEN aliases <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END + {_weigh('fin', 'low', 1.8, 0.7)} - {_weigh('neg', 'low', 1.6, 0.7)} - CASE WHEN {_squeeze('title')} = '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""
        {MATCHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY record_no ORDER BY n * 10 + longest DESC, ts_code) AS r FROM by_stock),
        subset AS (SELECT record_no, max(ts_code) FILTER (WHERE r = 1) AS primary_ts_code, max(name) FILTER (WHERE r = 1) AS primary_name, string_agg(matched_aliases, '|' ORDER BY r) AS aliases, count(*) AS stocks FROM ranked GROUP BY 1),
        t AS (SELECT s.*, a.id, a.title, a.publish_date, lower(coalesce(a.title, '')) AS low, {_hits(LOW, W.STUDY_FINANCE)} AS fin, {_hits(LOW, W.STUDY_NEGATIVE)} AS neg,
            list_contains(string_split(s.aliases, '|'), s.primary_name) OR contains({BOTH}, s.primary_name) AS full_name FROM subset s JOIN news_articles a ON s.record_no = a.record_no),
        c AS (SELECT *, {_r4(score)} AS study_score FROM t),
        study AS (SELECT *, ((full_name AND study_score >= 4.5 AND len(fin) > 0) OR (study_score >= 7 AND len(fin) >= 2)) AND NOT (NOT full_name AND aliases <> '' AND study_score < 8.5) AND NOT (len(neg) > 0 AND NOT full_name AND study_score < 9.5) AS study_keep FROM c)
    """


def oracle_sql() -> dict[str, str]:
    quarter = f"""
        WITH {QUARTER}, wanted AS (SELECT DISTINCT record_no, ts_code FROM candidates), art AS (SELECT record_no, {_squeeze('title')} AS t, {_squeeze("substr(coalesce(body, ''), 1, 1600)")} AS b, {_squeeze(EXCERPT)} AS both_squeezed, len({_hits(f'lower({EXCERPT})', W.QUARTER_FINANCE)}) AS fin, len({_hits(f'lower({EXCERPT})', W.QUARTER_NOISE)}) AS noise FROM news_articles),
        f AS (SELECT a.record_no, x.ts_code, x.alias, x.squeezed, {_squeeze('x.name')} AS full_name, contains(a.t, x.squeezed) AS in_title, fin, noise, a.t = '' AS untitled FROM art a JOIN wanted w ON w.record_no = a.record_no JOIN aliases x ON x.ts_code = w.ts_code AND (contains(a.t, x.squeezed) OR contains(a.b, x.squeezed))),
        g AS (SELECT record_no, ts_code, count(*) FILTER (WHERE in_title) AS title_hits, count(*) FILTER (WHERE NOT in_title) AS body_hits, max(length(squeezed)) AS longest, max((squeezed = full_name)::INT) AS has_full_name, max((alias IN ({', '.join(f"'{a}'" for a in W.AMBIGUOUS)}))::INT) AS amb, any_value(fin) AS fin, any_value(noise) AS noise, any_value(untitled) AS untitled FROM f GROUP BY ALL),
        s AS (SELECT *, {_r4("CASE WHEN has_full_name = 1 THEN 8.0::DOUBLE ELSE 0 END + title_hits * 4.0 + body_hits * 1.5 + least(fin, 6) * 0.8 - least(noise, 4) * 0.8 + CASE WHEN longest >= 4 THEN 1.0 WHEN longest = 3 THEN 0.4 ELSE -0.2 END - CASE WHEN untitled THEN 0.5 ELSE 0 END - CASE WHEN has_full_name = 0 AND amb = 1 THEN 1.0 ELSE 0 END")} AS score FROM g),
        kept AS (SELECT * FROM s WHERE NOT (has_full_name = 0 AND amb = 1 AND fin < 2 AND title_hits = 0) AND NOT (has_full_name = 0 AND fin = 0 AND title_hits = 0) AND score >= 2.5)
    """
    match = f"{MATCHED}, matched AS (SELECT record_no, ts_code, name AS stock_name, matched_aliases, CAST(n * 10 + longest AS BIGINT) AS match_score FROM by_stock)"
    profile_columns = ", ".join(_r4(c) + f" AS {c}" if c in LATE else c for c in "publish_date ts_code stock_name industry article_count mention_count net_sentiment_factor negative_shock_factor attention_factor sentiment_dispersion_factor event_density_factor risk_ratio positive_ratio neutral_ratio negative_ratio dominant_event_type top_keywords".split() + LATE[:7] + [f"{b}_event_factor" for b in W.EVENT_FACTORS.values()] + LATE[7:])
    buckets = lambda src, x, y: f"SELECT factor, direction, horizon, avg({y}) FILTER (WHERE round({x}, 12) >= round(hi, 12)) AS top, avg({y}) FILTER (WHERE round({x}, 12) <= round(lo, 12)) AS bottom FROM (SELECT *, quantile_cont({x}, 0.7) OVER g AS hi, quantile_cont({x}, 0.3) OVER g AS lo FROM {src} WINDOW g AS (PARTITION BY factor, horizon)) GROUP BY ALL"
    rank = lambda x: f"rank() OVER (PARTITION BY factor, horizon ORDER BY {x}) + (count(*) OVER (PARTITION BY factor, horizon, {x}) - 1) / 2.0::DOUBLE"
    corr = lambda a, b: f"CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr({a}, {b}) END"
    grid = []
    for p in ("direct", "state", "event", "optimized"):
        grid.append(f"SELECT '{p}' AS preset, publish_date, ts_code, round(0.5 + ({_score(ranking.preset(p))} - 0.5) * multiplier, 10) AS ranking_score FROM sg")
    every = {f.name: f.direction for p in ("direct", "state", "event", "optimized") for f in ranking.preset(p)}
    return {
        "ref_s9_universe": f"WITH {UNIVERSE} SELECT ts_code, name, industry, string_agg(alias, '|' ORDER BY place) AS aliases FROM cleaned GROUP BY ts_code, name, industry",
        "ref_p1_text": f"SELECT record_no, {_text('title')} AS title, {_text('url')} AS url, lower({_text('language')}) AS language, {_squeeze('title')} AS squeezed, substr({_text('publish_time')}, 1, 10) AS date_prefix FROM news_articles",
        "ref_p6_surrogate_id": f"SELECT record_no, CASE WHEN {_text('id')} <> '' THEN {_text('id')} ELSE substr(md5(coalesce(raw_source_file, '') || '|' || record_no || '|' || coalesce(title, '') || '|' || coalesce(publish_time, '')), 1, 16) END AS id FROM news_articles",
        "ref_p10_hits": f"SELECT record_no, array_to_string({_hits(LOW, W.STRONG)}, '|') AS hits FROM news_articles",
        "ref_f1_language": f"SELECT record_no, language FROM news_articles WHERE lower({_text('language')}) IN ('', 'zh') AND ({_text('title')} <> '' OR {_text('body')} <> '')",
        "ref_f3_keyword_filter": f"SELECT record_no FROM news_articles WHERE {_any(BOTH, ['诉讼', '库存', 'Audit', 'audit'])}",
        "ref_f4_date_range": "SELECT record_no, publish_date FROM news_articles WHERE coalesce(publish_date, '') >= '2023-10-10' AND coalesce(publish_date, '') <= '2023-11-10'",
        "ref_f5_date_range_keeping_empty": "SELECT record_no FROM news_articles WHERE coalesce(publish_date, '') = '' OR (publish_date >= '2023-10-10' AND publish_date <= '2023-11-10')",
        "ref_f6_date_range_dropping_empty": "SELECT record_no FROM news_articles WHERE coalesce(publish_date, '') <> '' AND publish_date <= '2023-11-10'",
        "ref_f7_broad_relevance": _broad(),
        "ref_f8_strict_relevance": _strict(),
        "ref_f12_alias_hits": f"WITH {QUARTER} SELECT record_no, ts_code, squeezed FROM candidates",
        "ref_f13_quarter_match": quarter + "SELECT record_no, ts_code, score, title_hits, body_hits, has_full_name FROM kept",
        "ref_t7_heap_topk": quarter + "SELECT * FROM (SELECT k.record_no, n.publish_date, ts_code, score, CAST(row_number() OVER (PARTITION BY n.publish_date, ts_code ORDER BY score DESC, k.record_no) AS INTEGER) AS place_in_day FROM kept k JOIN news_articles n ON k.record_no = n.record_no WHERE n.publish_date <> '') WHERE place_in_day <= 10",
        "ref_j1_coarse_match": f"WITH {COARSE} SELECT record_no, ts_code, name, industry, matched_aliases, coarse_score, candidate_rank FROM coarse WHERE candidate_rank <= 8",
        "ref_j2_record_match": f"WITH {match} SELECT *, CAST(row_number() OVER (PARTITION BY record_no ORDER BY match_score DESC, ts_code) AS INTEGER) AS match_rank FROM matched",
        "ref_w11_quota": f"WITH {match} SELECT record_no, ts_code FROM matched QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY record_no) <= 50",
        "ref_j4_industry": f"WITH {PROFILES}, {UNIVERSE} SELECT p.publish_date, p.ts_code, coalesce(i.industry, '') AS industry FROM p LEFT JOIN (SELECT ts_code, max(industry) AS industry FROM universe GROUP BY 1) i ON p.ts_code = i.ts_code",
        "ref_j8_uncovered_codes": f"WITH {UNIVERSE} SELECT DISTINCT ts_code FROM universe WHERE ts_code NOT IN (SELECT ts_code FROM market_prices WHERE close IS NOT NULL AND trade_date < DATE '2023-10-04' AND ts_code IS NOT NULL)",
        "ref_d1_dedup": f"WITH n AS (SELECT record_no, title, body, publish_time, CASE WHEN {_text('id')} <> '' THEN {_text('id')} ELSE substr(md5(coalesce(raw_source_file, '') || '|' || record_no || '|' || coalesce(title, '') || '|' || coalesce(publish_time, '')), 1, 16) END AS id FROM news_articles), a AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) SELECT record_no, id FROM a QUALIFY row_number() OVER (PARTITION BY title, body, publish_time ORDER BY record_no) = 1",
        "ref_d2_dedup_across_files": "SELECT record_no FROM news_articles QUALIFY row_number() OVER (PARTITION BY id, title, body, publish_time ORDER BY record_no) = 1",
        "ref_d3_first_id": "SELECT record_no FROM news_articles QUALIFY coalesce(id, '') = '' OR row_number() OVER (PARTITION BY id ORDER BY record_no) = 1",
        "ref_d6_repaired_union": f"WITH a AS (SELECT coalesce(ts_code, '') AS ts_code, {_num('confidence')} AS confidence, {_num('coarse_score')} AS coarse_score FROM article_mentions UNION ALL SELECT coalesce(ts_code, ''), 0.0, {_num('close')} FROM market_prices) SELECT ts_code, count(*) AS n, round(sum(confidence), 4) AS confidence, round(sum(coarse_score), 4) AS coarse_score FROM a GROUP BY 1",
        "ref_u1_rule_mentions": _rule_mentions(),
        "ref_a1_merged_mentions": f"WITH {_merged()} SELECT * FROM merged",
        "ref_u2_structured_news": f"WITH ment AS ({_rule_mentions()}), {COARSE} SELECT m.* EXCLUDE (record_no), m.stock_name || '相关' || m.event_type || '信息' AS event_summary, m.event_type AS merged_event_types, CAST(1 AS INTEGER) AS merged_event_count, c.coarse_score, c.matched_aliases, a.id AS news_id, a.publish_date, a.publish_time, a.title FROM ment m JOIN coarse c ON c.record_no = m.record_no AND c.ts_code = m.ts_code AND c.candidate_rank <= 8 JOIN news_articles a ON a.record_no = m.record_no",
        "ref_t9_diverse_topk": _diverse() + " SELECT publish_date, ts_code, news_id, CAST(pick AS INTEGER) AS pick, diversity_score FROM ordered WHERE pick <= 3",
        "ref_p15_mention_weight": f"WITH {MENTIONS} SELECT news_id, ts_code, {_r8(WEIGHT)} AS weight FROM m",
        "ref_a2_base_factors": f"WITH {BASE} SELECT * FROM base",
        "ref_a4_dominant_event": f"WITH {USABLE}, {DOMINANT} SELECT * FROM dominant",
        "ref_a5_top_keywords": f"WITH {USABLE}, {KEYWORDS} SELECT * FROM words",
        "ref_w1_states": f"WITH {STATES} SELECT {GROUP}, {', '.join(_r4(c) + f' AS {c}' for c in ['sentiment_delta_1d', 'sentiment_trend_factor', 'sentiment_momentum_factor', 'event_novelty_factor', 'ema3_sentiment_state', 'ema5_sentiment_state', 'negative_shock_carry', 'risk_event_state', 'composite_score'])} FROM states",
        "ref_a2_daily_profiles": f"WITH {STATES}, {DOMINANT}, {KEYWORDS}, {UNIVERSE}, full_rows AS (SELECT s.*, d.dominant_event_type, coalesce(k.top_keywords, '') AS top_keywords, coalesce(i.industry, '') AS industry FROM states s JOIN dominant d USING ({GROUP}) LEFT JOIN words k USING ({GROUP}) LEFT JOIN (SELECT ts_code, max(industry) AS industry FROM universe GROUP BY 1) i USING (ts_code)) SELECT {profile_columns}, {LABEL} AS profile_label FROM full_rows",
        "ref_p20_diversity_score": f"WITH {MENTIONS} SELECT news_id, ts_code, {_r4(' + '.join(f'{_num(c)} * {w}' for c, w in [('relevance', 0.35), ('confidence', 0.20), ('event_importance', 0.20), ('sentiment_strength', 0.15), ('coarse_score', 0.05)]) + ' + coalesce(merged_event_count, 1.0) * 0.05')} AS diversity_score FROM m",
        "ref_p21_enhanced_demo": f"WITH {BASE}, f AS (SELECT {GROUP}, net_sentiment_factor, negative_shock_factor, attention_factor, {_r4(_ema('net_sentiment_factor', '0.5::DOUBLE'))} AS ema3_sentiment_state, {_r4(_ema('net_sentiment_factor', '(1.0::DOUBLE / 3)'))} AS ema5_sentiment_state, {_r4(_CARRY)} AS negative_shock_carry FROM base WINDOW past AS ({_ORDER} ROWS UNBOUNDED PRECEDING)), v AS (SELECT {GROUP}, {', '.join(_r4(f'''sum(CASE WHEN event_type = '{e}' THEN {_num('sentiment')} * {_num('relevance')} * {_num('confidence')} * {_num('event_importance')} ELSE 0.0 END)''') + f' AS {chr(34)}{e}{chr(34)}' for e in W.EVENT_WEIGHTS)} FROM u GROUP BY {GROUP}) SELECT f.*, {_r4('0.50 * ema3_sentiment_state + 0.20 * ema5_sentiment_state - 0.25 * negative_shock_carry + 0.10 * attention_factor')} AS state_composite_demo, {', '.join(f'v.{chr(34)}{e}{chr(34)}' for e in W.EVENT_WEIGHTS)} FROM f JOIN v USING ({GROUP})",
        "ref_a12_event_crosstab": f"WITH {USABLE} SELECT ts_code, {', '.join(f'''count(*) FILTER (WHERE event_type = '{e}') AS {chr(34)}{e}{chr(34)}''' for e in W.EVENT_WEIGHTS)} FROM u GROUP BY 1",
        "ref_a13_event_sentiment": f"WITH {USABLE} SELECT ts_code, event_type, {_r4('avg(' + _num('sentiment') + ')')} AS mean_sentiment FROM u GROUP BY ALL",
        "ref_a14_column_means": f"WITH {MENTIONS} SELECT {', '.join(_r4(f'coalesce(avg({_finite(c)}), 0.0)') + f' AS {c}' for c in ('sentiment', 'confidence', 'relevance', 'coarse_score'))} FROM m",
        "ref_a21_counters": f"WITH {MENTIONS} SELECT ts_code, count(*) AS records, count(DISTINCT publish_date) AS days FROM m WHERE ts_code IS NOT NULL AND publish_date <> '' GROUP BY 1",
        "ref_p18_derived_features": f"WITH {DERIVED} SELECT publish_date, ts_code, {_r4('sentiment_confirmation_factor')} AS confirmation, {_r4('greatest(0.0, least(1.0, coverage_reliability_factor))')} AS coverage, {_r4('multiplier')} AS multiplier FROM dm",
        "ref_w8_percentile": f"WITH {PROFILES} SELECT publish_date, ts_code, round(sig_attention_factor, 8) AS attention_signal FROM (SELECT *, {_signals({'attention_factor': 1})} FROM p WINDOW day AS (PARTITION BY publish_date))",
        **{f"ref_a10_ranking_{p}": _rank_query(p) for p in ("direct", "state", "event", "optimized")},
        "ref_a11_ranking_summary": f"WITH {_OPT}, days AS (SELECT publish_date, count(DISTINCT ts_code) AS n, count(*) FILTER (WHERE rank_in_date <= 5) AS selected_count, string_agg(ts_code, '|' ORDER BY rank_in_date) FILTER (WHERE rank_in_date <= 5) AS selected FROM ranked GROUP BY 1) SELECT publish_date, selected_count, selected, (SELECT count(*) FROM days) AS dates, (SELECT count(DISTINCT ts_code) FROM ranked) AS stocks, (SELECT round(avg(n), 4) FROM days) AS mean_size FROM days",
        "ref_w7_forward_returns": f"WITH q AS (SELECT ts_code, trade_date, min(close) AS close FROM market_prices WHERE trade_date IS NOT NULL AND ts_code IS NOT NULL GROUP BY ALL) SELECT ts_code, strftime(trade_date, '%Y-%m-%d') AS trade_date, {', '.join(f'round(lead(close, {h}) OVER o / close - 1, 8) AS fwd_return_{h}d' for h in (1, 3, 5))} FROM q WINDOW o AS (PARTITION BY ts_code ORDER BY trade_date)",
        "ref_j5_asof_forward": f"WITH {PROFILES}, {QUOTES}, a AS ({ASOF.format(left='p')}) SELECT publish_date, ts_code, strftime(anchor, '%Y-%m-%d') AS anchor_trade_date, anchor_close, f1 AS fwd_return_1d FROM a",
        "ref_a15_topk_performance": f"WITH {TOPK} SELECT * FROM perf",
        "ref_a16_performance_summary": f"WITH {TOPK} SELECT horizon, count(*) FILTER (WHERE ok) AS n_dates, round(avg(topk_mean_return) FILTER (WHERE ok), 10) AS avg_topk_return, round(avg(universe_mean_return) FILTER (WHERE ok), 10) AS avg_universe_return, round(avg(topk_excess_return) FILTER (WHERE ok), 10) AS avg_excess_return, round(avg(top_bottom_spread) FILTER (WHERE ok), 10) AS avg_top_bottom_spread, round(avg((topk_excess_return > 0)::INT::DOUBLE) FILTER (WHERE ok), 10) AS hit_rate_vs_universe FROM (SELECT *, topk_mean_return IS NOT NULL AND universe_mean_return IS NOT NULL AND topk_excess_return IS NOT NULL AND top_bottom_spread IS NOT NULL AS ok FROM perf) GROUP BY horizon",
        "ref_a22_preset_grid": f"""
            WITH {DERIVED}, sg AS (SELECT *, {_signals(every)} FROM dm WINDOW day AS (PARTITION BY publish_date)), {QUOTES}, scored AS ({' UNION ALL '.join(grid)}),
            rk AS (SELECT *, row_number() OVER (PARTITION BY preset, publish_date ORDER BY ranking_score DESC, ts_code) AS r FROM scored), panel AS ({ASOF.format(left='rk')}), ks AS (SELECT *, unnest([1, 3, 5]) AS k FROM panel),
            lng AS (SELECT preset, k, publish_date, ts_code, ranking_score, r <= k AS picked, h.horizon AS horizon, CASE WHEN isnan(h.ret) THEN NULL ELSE h.ret END AS ret FROM (SELECT *, unnest([{{'horizon': 1, 'ret': f1}}, {{'horizon': 3, 'ret': f3}}, {{'horizon': 5, 'ret': f5}}]) AS h FROM ks)),
            placed AS (SELECT *, count(*) FILTER (WHERE picked AND ret IS NOT NULL) OVER (PARTITION BY preset, k, publish_date, horizon) AS n, row_number() OVER (PARTITION BY preset, k, publish_date, horizon ORDER BY ret IS NULL, ranking_score, ts_code) AS low FROM lng),
            agg AS (SELECT preset, k, publish_date, horizon, avg(ret) FILTER (WHERE picked) AS t, avg(ret) AS a, avg(ret) FILTER (WHERE low <= n) AS b FROM placed GROUP BY ALL),
            perf AS (SELECT preset, k, horizon, round(t, 10) AS t, round(CASE WHEN t IS NOT NULL THEN a END, 10) AS a, round(t - a, 10) AS e, round(t - b, 10) AS s FROM agg)
            SELECT preset, k, horizon, count(t) AS n_dates, round(avg(t), 10) AS avg_topk_return, round(avg(a), 10) AS avg_universe_return, round(avg(e), 10) AS avg_excess_return, round(avg(s), 10) AS avg_top_bottom_spread, round(avg(CASE WHEN e IS NOT NULL THEN (e > 0)::INT::DOUBLE END), 10) AS hit_rate_vs_universe FROM perf GROUP BY ALL
        """,
        "ref_a17_time_series": f"WITH {_time_series()}, rk AS (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM lng), st AS (SELECT factor, direction, horizon, count(*) AS n_obs, {corr('x', 'y')} AS p, {corr('rx', 'ry')} AS s FROM rk GROUP BY ALL HAVING count(*) >= 5), bk AS ({buckets('lng', 'x', 'y')}) SELECT factor, horizon, n_obs, {_r8('p')} AS pearson_corr, {_r8('s')} AS spearman_corr, {_r8('top')} AS top_bucket_mean_return, {_r8('bottom')} AS bottom_bucket_mean_return, {_r8('(top - bottom) * direction')} AS expected_top_bottom_gap FROM st JOIN bk USING (factor, direction, horizon)",
        "ref_a18_cross_section": f"WITH {_time_series()}, two AS (SELECT ts_code FROM panel WHERE f1 IS NOT NULL AND NOT isnan(f1) GROUP BY ts_code ORDER BY count(*) DESC, ts_code LIMIT 2), pr AS (SELECT publish_date, factor, direction, horizon, round((arg_min(x, ts_code) - arg_max(x, ts_code)) * direction, 10) AS dx, round(arg_min(y, ts_code) - arg_max(y, ts_code), 10) AS dy FROM lng WHERE ts_code IN (SELECT ts_code FROM two) GROUP BY publish_date, factor, direction, horizon HAVING count(DISTINCT ts_code) = 2), rk AS (SELECT *, {rank('dx')} AS rx, {rank('dy')} AS ry FROM pr), st AS (SELECT factor, direction, horizon, count(*) AS n_dates, {corr('dx', 'dy')} AS p, {corr('rx', 'ry')} AS s, avg((sign(dx) = sign(dy))::INT::DOUBLE) AS hit FROM rk GROUP BY ALL HAVING count(*) >= 5), bk AS ({buckets('pr', 'dx', 'dy')}) SELECT factor, horizon, n_dates, {_r8('p')} AS spread_corr, {_r8('s')} AS spread_rank_corr, {_r8('hit')} AS rank_hit_rate, {_r8('top')} AS top_bucket_return_spread, {_r8('bottom')} AS bottom_bucket_return_spread, {_r8('top - bottom')} AS top_bottom_spread_gap FROM st JOIN bk USING (factor, direction, horizon)",
        "ref_a19_direction": f"WITH {_time_series()}, s AS (SELECT factor, horizon, y, x * direction AS g, abs(x * direction) > 1e-12 AS moved FROM lng), t AS (SELECT factor, horizon, count(*) AS a, count(*) FILTER (WHERE moved) AS n_obs, avg((sign(g) = sign(y))::INT::DOUBLE) FILTER (WHERE moved) AS hit, avg((y > 0)::INT::DOUBLE) FILTER (WHERE moved) AS up, avg((y < 0)::INT::DOUBLE) FILTER (WHERE moved) AS down FROM s GROUP BY ALL) SELECT factor, horizon, n_obs, {_r8('hit')} AS raw_direction_hit_rate, {_r8('up')} AS market_up_ratio, {_r8('down')} AS market_down_ratio, {_r8('greatest(up, down)')} AS market_majority_hit_rate, {_r8('hit - greatest(up, down)')} AS excess_hit_rate_vs_market FROM t WHERE a >= 5 AND n_obs >= 5",
        "ref_s3_lenient_lines": "SELECT feed, file_no, count(*) AS objects FROM raw_records WHERE json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT' GROUP BY ALL",
        "ref_f10_study_relevance": f"WITH {_study()} SELECT record_no, primary_ts_code, study_score, study_keep, array_to_string(fin, '|') AS study_finance_hits, array_to_string(neg, '|') AS study_negative_hits, full_name::INT AS study_has_full_name, (NOT full_name AND aliases <> '')::INT AS study_alias_only FROM study",
        "ref_t5_best_per_stock": f"WITH {_study()} SELECT record_no, primary_ts_code, study_score FROM study WHERE study_score >= 4 QUALIFY row_number() OVER (PARTITION BY primary_ts_code ORDER BY study_score DESC, publish_date NULLS FIRST, id NULLS FIRST) <= 20",
        "ref_t6_daily_topk": f"WITH {_study()}, once AS (SELECT * FROM study WHERE coalesce(publish_date, '') <> '' QUALIFY coalesce(id, '') = '' OR row_number() OVER (PARTITION BY id ORDER BY record_no) = 1) SELECT record_no, publish_date, primary_ts_code, CAST(row_number() OVER d AS INTEGER) AS place_in_day FROM once WINDOW d AS (PARTITION BY publish_date, primary_ts_code ORDER BY study_score DESC, full_name::INT DESC, stocks, greatest(1, len(fin)) DESC, id NULLS FIRST) QUALIFY row_number() OVER d <= 3",
        "ref_u1_overview": f"WITH ment AS ({_rule_mentions()}), o AS (SELECT record_no, sum(sentiment * relevance) / sum(greatest(relevance, 0.05)) AS o FROM ment GROUP BY 1) SELECT a.record_no, CASE WHEN coalesce(a.title, '') = '' THEN '新闻摘要' ELSE substr(a.title, 1, 80) END AS article_summary, {_r4('greatest(-1.0, least(1.0, coalesce(o.o, 0.0)))')} AS overall_sentiment FROM news_articles a LEFT JOIN o ON a.record_no = o.record_no",
        "ref_u2_skipped_news": f"WITH {MATCHED} SELECT id AS news_id, publish_time, title, 'no_alias_match' AS reason, CAST(0 AS INTEGER) AS candidate_count FROM news_articles WHERE record_no NOT IN (SELECT record_no FROM by_stock)",
        "ref_p16_labels": f"WITH {PROFILES}, f AS (SELECT publish_date, ts_code, {', '.join(_num(c) + f' AS {c}' for c in ('attention_factor', 'net_sentiment_factor', 'sentiment_momentum_factor', 'negative_shock_factor', 'risk_ratio'))} FROM p) SELECT publish_date, ts_code, {LABEL} AS label FROM f",
        "ref_p11_clamp": f"WITH {PROFILES} SELECT publish_date, ts_code, {_r4('greatest(0.0, least(1.0, ' + _num('negative_shock_carry') + '))')} AS carry FROM p",
    }
