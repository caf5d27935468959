"""The registered queries again as SQL for DuckDB, written from the definitions."""

from __future__ import annotations

# fixed values, written out once more: a wrong one in the library shows
STATIC_FEATURES = [
    "time_interval_std",
    "upload_burst_ratio",
    "video_upload_frequency",
    "view_per_video",
    "dash_density",
    "title_length_std",
    "capitalization_ratio",
    "opening_repeat_ratio",
    "temporal_clickbait_ratio",
    "type_token_ratio",
    "avg_title_similarity",
    "sub_to_view_ratio",
    "subscriber_velocity",
]
CLICKBAIT_PHRASES = [
    r"(?i)\byou (won'?t|will never) believe\b",
    r"(?i)\bthe (dark |hidden |shocking |untold |real |secret )?truth\b",
    r"(?i)\bwhat (nobody|no one) tells you\b",
    r"(?i)\bchanged (everything|the world|history)\b",
    r"(?i)\bmost people don'?t know\b",
    r"(?i)\bgenius of\b",
    r"(?i)\bexplained (simply|in \d+ minutes?)\b",
    r"(?i)\bthis (changes|will change) everything\b",
    r"(?i)\bthe (mind|brain) of\b",
    r"(?i)\bfeynman (explains|on|about|method)\b",
    r"(?i)\beinstein (explains|on|about)\b",
    r"(?i)\bcarl sagan (on|about|explains)\b",
    r"(?i)\bnot .{1,30} but\b",
    r"(?i)\bfew people (know|realize)\b",
    "ít ai biết",
    "sự thật (kinh hoàng|bí ẩn|đáng sợ|không ngờ)",
    "không phải .{1,20} mà là",
    "(bí mật|bí ẩn) (đằng sau|của|về)",
    "tại sao (không ai|ít người)",
    "review phim",
]
EXCLUDE_KEYWORDS = [
    "rain sound",
    "sleep music",
    "relaxing white noise",
    "lofi hip hop",
    "meditation music",
    "asmr",
    "deep sleep",
    "10 hours",
]
LOW_RESULT_QUERIES = [
    "nhạc lofi chill giảm stress",
    "âm thanh mưa ngủ ngon 8 tiếng",
    "lofi hip hop radio to relax",
    "deep sleep rain sounds 10 hours",
]
DASHES = "—|--|–"
VIETNAMESE_LETTERS = (
    "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
)

SQL: dict[str, str] = {}

ASOF = "TIMESTAMP '2002-01-01 00:00:00'"
WS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
DAY = "CAST(86400000000 AS DOUBLE)"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def add(name: str, ctes: list[str], body: str, doubles: list[str] = ()) -> None:
    head = ("WITH " + ",\n".join(ctes) + "\n") if ctes else ""
    if doubles:
        repl = ", ".join(f'round("{d}", 6) AS "{d}"' for d in doubles)
        body = f"SELECT * REPLACE ({repl}) FROM ({body})"
    SQL[name] = head + body


# --- views ----------------------------------------------------------------------
UP_ORD = "up AS (SELECT o_custkey AS channel_id, o_orderdate AS ts FROM orders)"
UP_EV = "up AS (SELECT user_id AS channel_id, ts FROM events)"
GAPS = f"""g AS (
  SELECT channel_id, ts, row_number() OVER w - 1 AS seq,
         (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / {DAY} AS days,
         count(*) OVER (PARTITION BY channel_id) AS n
  FROM up WINDOW w AS (PARTITION BY channel_id ORDER BY ts))"""
TIM = """med AS (SELECT channel_id, median(days) AS m FROM g WHERE days <= 365 GROUP BY 1),
tim AS (
  SELECT g.channel_id, count(*) AS n_timestamps, min(ts) AS first_at,
         count(*) FILTER (WHERE days <= 365) AS n_intervals,
         CASE WHEN count(*) >= 3 AND count(*) FILTER (WHERE days <= 365) >= 2
              THEN stddev_pop(days) FILTER (WHERE days <= 365) ELSE CAST(-1 AS DOUBLE) END AS time_interval_std,
         CASE WHEN count(*) >= 3 AND count(*) FILTER (WHERE days <= 365) >= 1
              THEN avg(CASE WHEN days < CAST(0.3 AS DOUBLE) * m THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
                   FILTER (WHERE days <= 365)
              ELSE CAST(0 AS DOUBLE) END AS upload_burst_ratio
  FROM g LEFT JOIN med USING (channel_id) GROUP BY g.channel_id)"""
CH = """ch AS (
  SELECT c_custkey AS channel_id, c_name AS title,
         CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS label,
         CAST(floor(c_acctbal) AS BIGINT) AS subscriber_count,
         v AS view_count, n AS video_count,
         CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 0 ELSE n END AS n_videos_crawled
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(floor(round(sum(o_totalprice), 2)) AS BIGINT) AS v, count(*) AS n
    FROM orders GROUP BY 1) s ON o_custkey = c_custkey)"""
LINES = """ln AS (
  SELECT doc_id, source, i - 1 AS i, parts[i] AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""


def dressed(key: str) -> str:
    return f"""dressed AS (
  SELECT {key} AS channel_id, doc_id * 1000000 + i AS pos,
    CASE WHEN (doc_id + i) % 13 = 0 THEN '***' ELSE
      CASE WHEN (doc_id + i) % 17 = 0 THEN 'The hidden truth ' ELSE '' END
      || CASE WHEN (doc_id + i) % 7 = 0 THEN translate(line, '{LOWER}', '{UPPER}') ELSE line END
      || CASE WHEN (doc_id + i) % 3 = 0 THEN ' — part ' || doc_id ELSE '' END
      || CASE WHEN (doc_id + i) % 5 = 0 THEN '?' ELSE '' END
      || CASE WHEN (doc_id + i) % 11 = 0 THEN ' -- – ' ELSE '' END END AS title
  FROM ln)"""


def clean(source: str) -> str:
    return f"""tt AS (
  SELECT * FROM (
    SELECT channel_id, pos, regexp_replace(title, '^[{WS}]+|[{WS}]+$', '', 'g') AS title
    FROM {source}) WHERE title <> '')"""


CONV = "conv AS (SELECT conv_id AS channel_id, turn AS pos, text AS title FROM conversations)"


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


# every phrase on its own, case-blind where it says so
ANY_PHRASE = "(" + " OR ".join(f"regexp_matches(title, {lit(p)})" for p in CLICKBAIT_PHRASES) + ")"
STYLE = f"""sty AS (
  SELECT channel_id, count(*) AS n_titles,
    coalesce(sum({n_of('title', DASHES)})::DOUBLE
      / nullif(sum({n_of('title', f'[^{WS}]+')}), 0)::DOUBLE, 0) AS dash_density,
    CASE WHEN count(*) >= 2 THEN stddev_pop(length(title)::DOUBLE) ELSE 0 END AS title_length_std,
    coalesce(avg(CASE WHEN {n_of('title', r'\p{L}')} > 0
      THEN {n_of('title', r'\p{Lu}')}::DOUBLE / {n_of('title', r'\p{L}')} END), 0) AS capitalization_ratio,
    avg(CASE WHEN regexp_matches(title, '[?!]|\\p{{Nd}}') THEN 1.0::DOUBLE ELSE 0 END) AS click_share,
    avg(CASE WHEN {ANY_PHRASE} THEN 1.0::DOUBLE ELSE 0 END)
      AS clickbait_phrase_ratio,
    sum({n_of('lower(title)', f'[{VIETNAMESE_LETTERS}]')}) >= 3 AS vi
  FROM tt GROUP BY channel_id)"""


def vocab(is_vi: str, plain: str) -> str:
    """`is_vi` selects (channel_id, vi) and `plain` tokenizes a title of other channels."""
    return f"""tk AS (
  SELECT tt.channel_id, pos,
    CASE WHEN f.vi THEN regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+') ELSE {plain} END AS toks
  FROM tt JOIN ({is_vi}) f USING (channel_id)),
ttr AS (SELECT channel_id, count(DISTINCT tok)::DOUBLE / count(tok) AS type_token_ratio
        FROM (SELECT channel_id, unnest(toks) AS tok FROM tk) GROUP BY 1),
opn AS (SELECT channel_id, 1.0::DOUBLE - count(DISTINCT op)::DOUBLE / count(op) AS opening_repeat_ratio
        FROM (SELECT channel_id, array_to_string(toks[1:3], ' ') AS op FROM tk WHERE len(toks) > 0)
        GROUP BY 1),
voc AS (SELECT c.channel_id, coalesce(type_token_ratio, 0) AS type_token_ratio,
               coalesce(opening_repeat_ratio, 0) AS opening_repeat_ratio
        FROM (SELECT DISTINCT channel_id FROM tt) c
        LEFT JOIN ttr USING (channel_id) LEFT JOIN opn USING (channel_id))"""


WORDS = r"regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')"
BLANKS = f"regexp_extract_all(lower(title), '[^{WS}]+')"

# explicit vectors and explicit pairs: the definition itself
SIM = r"""top AS (
  SELECT channel_id, pos, title FROM tt
  QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY pos) <= 10),
tw AS (SELECT channel_id, pos, regexp_extract_all(lower(title), '[\p{L}\p{N}_]{2,}') AS w FROM top),
te AS (
  SELECT channel_id, pos, unnest(w) AS term FROM tw
  UNION ALL
  SELECT channel_id, pos, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM tw),
tf AS (SELECT channel_id, pos, term, count(*) AS tf FROM te GROUP BY ALL),
vo AS (SELECT channel_id, term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY channel_id, term
       QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY sum(tf) DESC, term) <= 5000),
nn AS (SELECT channel_id, count(*) AS n FROM top GROUP BY 1),
wt AS (SELECT channel_id, pos, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w
       FROM tf JOIN vo USING (channel_id, term) JOIN nn USING (channel_id)),
un AS (SELECT channel_id, pos, term, w / sqrt(sum(w * w) OVER (PARTITION BY channel_id, pos)) AS u FROM wt),
pr AS (SELECT a.channel_id, sum(a.u * b.u) AS s FROM un a JOIN un b
       ON a.channel_id = b.channel_id AND a.term = b.term AND a.pos < b.pos GROUP BY 1),
sim AS (SELECT channel_id, CASE WHEN n >= 2 THEN coalesce(s, 0) / (n * (n - 1) / 2.0::DOUBLE) ELSE 0 END
          AS avg_title_similarity
        FROM nn LEFT JOIN pr USING (channel_id))"""

AGE = f"""CASE WHEN first_at IS NULL THEN -1.0::DOUBLE
  ELSE greatest((epoch_us({ASOF}) - epoch_us(first_at)) / {DAY}, 1.0::DOUBLE) END"""


def velocity(c: str) -> str:
    return f"CASE WHEN age <= 0 OR {c} IS NULL THEN -1.0::DOUBLE WHEN {c} <= 0 THEN 0 ELSE {c} / age END"


def frequency(crawled: str) -> str:
    return f"""CASE WHEN age <= 0 THEN -1.0::DOUBLE ELSE (CASE WHEN {crawled} > 0 THEN {crawled}
      WHEN video_count > 0 THEN video_count ELSE n_timestamps END)::DOUBLE / age END"""


VPV = "CASE WHEN video_count > 0 THEN view_count::DOUBLE / video_count WHEN video_count <= 0 THEN 0.0::DOUBLE END"
SVR = "subscriber_count::DOUBLE / (view_count::DOUBLE + 1)"
TIMED = f"td AS (SELECT *, {AGE} AS age FROM ch LEFT JOIN tim USING (channel_id))"
VR = "CASE WHEN sv > 0 AND vv > 0 THEN log10((sv + 1) / (vv + 1)) ELSE 0.0::DOUBLE END"

# --- timing ---------------------------------------------------------------------
add("upload_cadence_events", [UP_EV, GAPS, TIM],
    "SELECT channel_id, n_timestamps, n_intervals, time_interval_std, upload_burst_ratio FROM tim",
    ["time_interval_std", "upload_burst_ratio"])
add("upload_intervals", [UP_ORD, GAPS],
    "SELECT channel_id, seq, days FROM g WHERE n >= 3 AND days <= 365", ["days"])
add("time_interval_std", [UP_ORD, GAPS, TIM],
    "SELECT channel_id, time_interval_std FROM tim", ["time_interval_std"])
add("upload_burst_ratio", [UP_ORD, GAPS, TIM],
    "SELECT channel_id, upload_burst_ratio FROM tim", ["upload_burst_ratio"])
add("upload_frequency", [UP_ORD, GAPS, TIM, CH, TIMED],
    f"SELECT channel_id, age AS channel_age_days, {frequency('n_videos_crawled')} AS video_upload_frequency FROM td",
    ["channel_age_days", "video_upload_frequency"])
add("view_per_video", [CH], f"SELECT channel_id, {VPV} AS view_per_video FROM ch", ["view_per_video"])
add("sub_to_view_ratio", [CH], f"SELECT channel_id, {SVR} AS sub_to_view_ratio FROM ch",
    ["sub_to_view_ratio"])
add("subscriber_velocity", [UP_ORD, GAPS, TIM, CH, TIMED],
    f"SELECT channel_id, {velocity('subscriber_count')} AS subscriber_velocity FROM td",
    ["subscriber_velocity"])
add("velocity_ratio", [UP_ORD, GAPS, TIM, CH, TIMED],
    f"""SELECT channel_id, vv AS view_velocity, {VR} AS velocity_ratio
    FROM (SELECT channel_id, {velocity('subscriber_count')} AS sv, {velocity('view_count')} AS vv FROM td)""",
    ["view_velocity", "velocity_ratio"])

# --- titles ---------------------------------------------------------------------
SRC = [LINES, dressed("source"), clean("dressed")]
DOC = [LINES, dressed("doc_id"), clean("dressed")]
for _c in ("dash_density", "title_length_std", "capitalization_ratio"):
    add(_c, SRC + [STYLE], f"SELECT channel_id, {_c} FROM sty", [_c])
add("clickbait_phrases", DOC + [STYLE],
    "SELECT channel_id, n_titles, clickbait_phrase_ratio FROM sty", ["clickbait_phrase_ratio"])
BY_STYLE = "SELECT channel_id, vi FROM sty"
for _c in ("opening_repeat_ratio", "type_token_ratio"):
    add(_c, SRC + [STYLE, vocab(BY_STYLE, WORDS)], f"SELECT channel_id, {_c} FROM voc", [_c])
add("features_whitespace_tokens",
    [UP_ORD, GAPS, TIM, CH, TIMED] + DOC
    + [vocab("SELECT channel_id, channel_id % 3 = 0 AS vi FROM ch", BLANKS)],
    f"""SELECT channel_id, -1 AS label, coalesce(type_token_ratio, 0) AS type_token_ratio,
      coalesce(opening_repeat_ratio, 0) AS opening_repeat_ratio,
      {frequency('n_timestamps')} AS video_upload_frequency, coalesce(n_timestamps, 0) AS n_videos_crawled
    FROM td LEFT JOIN voc USING (channel_id)""",
    ["type_token_ratio", "opening_repeat_ratio", "video_upload_frequency"])
add("temporal_clickbait_ratio", [UP_ORD, GAPS, TIM] + DOC + [STYLE],
    """SELECT channel_id, CASE WHEN coalesce(time_interval_std, -1) < 0 THEN 0 ELSE click_share / (1 + time_interval_std) END
      AS temporal_clickbait_ratio FROM sty LEFT JOIN tim USING (channel_id)""", ["temporal_clickbait_ratio"])
for _n, _v in (("sources", SRC), ("docs", DOC), ("conversations", [CONV, clean("conv")])):
    add(f"avg_title_similarity_{_n}", _v + [SIM], "SELECT channel_id, avg_title_similarity FROM sim",
        ["avg_title_similarity"])


def features(crawled: str, shown: str) -> str:
    return f"""f AS (
  SELECT channel_id, title, label,
    coalesce(time_interval_std, -1) AS time_interval_std,
    coalesce(upload_burst_ratio, 0) AS upload_burst_ratio,
    {frequency(crawled)} AS video_upload_frequency, {VPV} AS view_per_video,
    coalesce(dash_density, 0) AS dash_density, coalesce(title_length_std, 0) AS title_length_std,
    coalesce(capitalization_ratio, 0) AS capitalization_ratio,
    coalesce(opening_repeat_ratio, 0) AS opening_repeat_ratio,
    CASE WHEN click_share IS NULL OR coalesce(time_interval_std, -1) < 0 THEN 0
      ELSE click_share / (1 + time_interval_std) END AS temporal_clickbait_ratio,
    coalesce(type_token_ratio, 0) AS type_token_ratio,
    coalesce(avg_title_similarity, 0) AS avg_title_similarity, {SVR} AS sub_to_view_ratio,
    {velocity('subscriber_count')} AS subscriber_velocity, {velocity('view_count')} AS vv,
    subscriber_count, view_count, video_count, {shown} AS n_videos_crawled,
    coalesce(clickbait_phrase_ratio, 0) AS clickbait_phrase_ratio
  FROM td LEFT JOIN sty USING (channel_id) LEFT JOIN voc USING (channel_id)
    LEFT JOIN sim USING (channel_id))"""


add("build_features",
    [UP_ORD, GAPS, TIM, CH, TIMED] + DOC + [STYLE, vocab(BY_STYLE, WORDS), SIM,
                                            features("n_videos_crawled", "n_videos_crawled::DOUBLE")],
    "SELECT * EXCLUDE (vv), CASE WHEN subscriber_velocity > 0 AND vv > 0"
    " THEN log10((subscriber_velocity + 1) / (vv + 1)) ELSE 0.0::DOUBLE END AS sub_to_view_velocity_ratio FROM f",
    STATIC_FEATURES + ["n_videos_crawled", "sub_to_view_velocity_ratio", "clickbait_phrase_ratio"])
PLAIN = [LINES, "plain AS (SELECT doc_id AS channel_id, i AS pos, line AS title FROM ln)", clean("plain")]
add("scoring_features",
    [UP_ORD, GAPS, TIM, CH, TIMED] + PLAIN + [STYLE, vocab(BY_STYLE, WORDS), SIM,
                                              features("n_timestamps", "coalesce(n_timestamps, 0)")],
    "SELECT * EXCLUDE (vv, clickbait_phrase_ratio, subscriber_count, view_count, video_count) FROM f",
    STATIC_FEATURES)

# --- language -------------------------------------------------------------------
add("language_fallback", [],
    f"""SELECT doc_id AS channel_id, CASE WHEN {n_of('lower(text)', f'[{VIETNAMESE_LETTERS}]')} >= 3
      THEN 'vi' ELSE 'en' END AS language FROM documents""")
GRAMS = r"""cl AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g') AS t FROM documents),
st AS (SELECT doc_id, lang, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM cl),
ab AS (SELECT doc_id, lang, c, c || lead(c) OVER w AS c2, c || lead(c) OVER w || lead(c, 2) OVER w AS c3
       FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT doc_id, lang, c AS gram FROM ab UNION ALL SELECT doc_id, lang, c2 FROM ab WHERE c2 IS NOT NULL
       UNION ALL SELECT doc_id, lang, c3 FROM ab WHERE c3 IS NOT NULL),
dg AS (SELECT doc_id, lang, gram, count(*) AS c FROM gr WHERE trim(gram) <> '' GROUP BY ALL),
pf AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) AS rank
       FROM (SELECT lang, gram, sum(c) AS c FROM dg GROUP BY ALL) QUALIFY rank <= 300)"""
add("language_profiles", [GRAMS], "SELECT lang, gram, rank FROM pf")
add("language_identify", [GRAMS, """dr AS (
  SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, gram) AS r
  FROM dg QUALIFY r <= 300),
ds AS (
  SELECT doc_id, l.lang AS language, sum(coalesce(abs(r - pf.rank), 300)) AS distance
  FROM dr CROSS JOIN (SELECT DISTINCT lang FROM pf) l
  LEFT JOIN pf ON pf.lang = l.lang AND pf.gram = dr.gram GROUP BY ALL)"""],
    "SELECT doc_id, language FROM ds QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, language DESC) = 1")

# --- sources --------------------------------------------------------------------
ISO = "strftime(o_orderdate{}, '%Y-%m-%dT%H:%M:%SZ')"
JU = f"""cells AS (
  SELECT o_custkey AS channel_id, CASE WHEN o_orderkey % 50 = 0 THEN '[oops' WHEN o_orderkey % 51 = 0 THEN NULL
    WHEN o_orderkey % 7 = 0 THEN '["2020-13-45","2020","' || {ISO.format('')} || '"]'
    ELSE '["' || {ISO.format(' + INTERVAL 1 DAY')} || '","' || {ISO.format('')} || '"]' END AS cell
  FROM orders),
good AS (
  SELECT channel_id, list_filter(list_transform(from_json(cell, '["VARCHAR"]'),
    lambda x: CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(x AS TIMESTAMP) END),
    lambda x: x IS NOT NULL) AS a
  FROM cells WHERE CASE WHEN json_valid(cell) THEN true ELSE false END),
el AS (SELECT channel_id, i - 1 AS pos, a[i] AS ts FROM good, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i))"""
add("json_uploads_roundtrip", [JU],
    """SELECT channel_id, count(*) AS n, sum(pos)::BIGINT AS sum_pos, min(epoch_us(ts)) AS first_us,
      max(epoch_us(ts)) AS last_us FROM el GROUP BY 1""")
JT = f"""jt AS (
  SELECT doc_id AS channel_id, list_filter(list_transform(string_split(text, chr(10)),
    lambda x: regexp_replace(x, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda x: x <> '') AS a FROM documents)"""
add("json_titles_roundtrip", [JT],
    """SELECT channel_id, len(a) AS n, (len(a) * (len(a) - 1) // 2)::BIGINT AS sum_pos,
      list_sum(list_transform(a, lambda x: length(x)))::BIGINT AS chars FROM jt WHERE len(a) > 0""")
add("flattened_titles", [JT], "SELECT channel_id, md5(array_to_string(a, ' ')) AS text_md5 FROM jt")
add("interval_cells_roundtrip", [UP_ORD, GAPS],
    """SELECT c_custkey AS channel_id, place::DOUBLE AS seq, days FROM customer
      LEFT JOIN (SELECT channel_id, days, seq // 100000 * 100000 - 1 + row_number() OVER (
        PARTITION BY channel_id, seq // 100000 ORDER BY seq) AS place
      FROM g WHERE n >= 3 AND days <= 365) k ON channel_id = c_custkey""",
    ["days"])
SEED = """sl AS (
  SELECT 'seeds_' || (c_custkey % 2) AS source_file, c_custkey AS line_no, CAST(c_custkey % 2 AS INTEGER) AS label,
    c_nationkey, CASE c_custkey % 8
      WHEN 0 THEN 'https://www.youtube.com/@Handle' || c_custkey
      WHEN 1 THEN 'https://www.youtube.com/channel/UC' || lpad(c_custkey::VARCHAR, 22, 'x')
      WHEN 2 THEN ' UC' || lpad(c_custkey::VARCHAR, 22, '0')
      WHEN 3 THEN 'https://www.youtube.com/@T%C3%AAn' || c_custkey || '+a'
      WHEN 4 THEN 'https://www.youtube.com/@HANDLE' || (c_custkey - 4)
      WHEN 5 THEN 'https://www.youtube.com/results?search_query=' || c_custkey
      WHEN 6 THEN '# note ' || c_custkey ELSE '   ' END AS value
  FROM customer),
u AS (SELECT *, url_decode(trim(value)) AS url, trim(value) AS v FROM sl),
r AS (SELECT *,
    regexp_extract(url, 'youtube\\.com/@([\\p{L}\\p{N}_\\-.]+)', 1) AS h,
    regexp_extract(url, 'youtube\\.com/channel/(UC[\\p{L}\\p{N}_\\-]+)', 1) AS c,
    CASE WHEN regexp_full_match(v, 'UC[\\p{L}\\p{N}_\\-]{22}') THEN v
         ELSE nullif(regexp_extract(v, 'channel/(UC[\\p{L}\\p{N}_\\-]+)', 1), '') END AS bare,
    url <> '' AND NOT starts_with(url, '#') AND NOT contains(url, 'results?')
      AND NOT contains(url, 'search_query') AS ok FROM u),
p AS (SELECT *, CASE WHEN ok AND h <> '' THEN 'handle' WHEN ok AND c <> '' THEN 'id' END AS url_type,
    CASE WHEN ok AND h <> '' THEN h WHEN ok AND c <> '' THEN c END AS url_value FROM r)"""
add("seeds_text_roundtrip", [SEED],
    """SELECT label, ref_type, ref_value FROM (
      SELECT *, coalesce(url_type, CASE WHEN bare IS NOT NULL THEN 'id' END) AS ref_type,
             coalesce(url_value, bare) AS ref_value FROM p) WHERE ref_type IS NOT NULL""")
add("csv_roundtrip", [CH],
    "SELECT * REPLACE (view_count::DOUBLE AS view_count, video_count::DOUBLE AS video_count,"
    " n_videos_crawled::DOUBLE AS n_videos_crawled) FROM ch")
add("parse_channel_refs", [SEED],
    """SELECT source_file, line_no, url_type AS ref_type, url_value AS ref_value, label FROM p
      WHERE url_type IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_file, url_type, lower(url_value) ORDER BY line_no) = 1""")
add("parse_any_ref", [SEED],
    """SELECT source_file, line_no, ref_type, ref_value, label FROM (
      SELECT *, coalesce(url_type, CASE WHEN bare IS NOT NULL THEN 'id' END) AS ref_type,
             coalesce(url_value, bare) AS ref_value FROM p)
      WHERE ref_type IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source_file, ref_type, lower(ref_value) ORDER BY line_no) = 1""")
add("extract_channel_ids", [SEED],
    """SELECT bare AS channel_id, CASE WHEN bool_or(c_nationkey < 10) THEN 0 ELSE 1 END AS label
      FROM p WHERE bare IS NOT NULL GROUP BY 1""")
add("seed_line_counts", [SEED],
    "SELECT source_file, label, count(*) FILTER (WHERE trim(value) <> '') AS n_lines FROM sl GROUP BY ALL")
add("limit_per_label", [SEED],
    """SELECT line_no, url_type AS ref_type, url_value AS ref_value, label FROM p WHERE url_type IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY label ORDER BY source_file, line_no) <= 25""")
add("anti_join_new", [],
    """SELECT c_custkey AS channel_id, c_mktsegment FROM customer WHERE c_custkey NOT IN
      (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
add("append_new", [], "SELECT DISTINCT o_custkey AS channel_id FROM orders")

# --- preparation ----------------------------------------------------------------
RAWN = """nl AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label,
  CASE WHEN l_linenumber = 1 THEN -1.0::DOUBLE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount, l_tax FROM lineitem)"""
NUMC = "nc AS (SELECT * REPLACE (nullif(l_quantity, -1) AS l_quantity) FROM nl)"
LONG = "lf AS (" + " UNION ALL ".join(
    f"SELECT label, '{c}' AS feature, {c} AS value FROM nc WHERE {c} IS NOT NULL" for c in NUM) + ")"
add("sentinel_to_null", [RAWN, NUMC],
    "SELECT label, count(*) AS n, count(l_quantity) AS n_present, sum(l_quantity) AS total FROM nc GROUP BY 1",
    ["total"])
add("null_ratios", [RAWN, NUMC],
    "SELECT " + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS {c}" for c in NUM)
    + " FROM nc WHERE label = 0", NUM)
LD = "ld AS (SELECT doc_id, quality AS label, n_chars FROM labels JOIN documents USING (doc_id))"
add("class_weights", [LD],
    """SELECT label, n, sum(n) OVER ()::DOUBLE / (count(*) OVER () * n) AS weight
      FROM (SELECT label, count(*) AS n FROM ld GROUP BY 1)""", ["weight"])
RK = """rk AS (SELECT doc_id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rank,
  count(*) OVER (PARTITION BY label) AS n FROM ld)"""
add("stratified_split", [LD, RK],
    "SELECT doc_id, label, rank <= round(0.2::DOUBLE * n) AS is_test FROM rk")
add("stratified_folds", [LD, RK], "SELECT doc_id, label, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM rk")
add("label_codes", [LD],
    "SELECT doc_id, CASE label WHEN 0 THEN 'genuine' ELSE 'slop' END AS label_name, label FROM ld")

# --- profile --------------------------------------------------------------------
add("label_distribution", [RAWN],
    "SELECT label, n, n / sum(n) OVER () * 100.0::DOUBLE AS share FROM (SELECT label, count(*) AS n FROM nl GROUP BY 1)",
    ["share"])
LONG_RAW = LONG.replace("FROM nc", "FROM nl")
add("feature_summary", [RAWN, LONG_RAW],
    """SELECT *, CASE WHEN slop_mean > genuine_mean THEN '↑slop' ELSE '↓slop' END AS direction FROM (
      SELECT feature, avg(value) FILTER (WHERE label = 1 AND value >= 0) AS slop_mean,
        avg(value) FILTER (WHERE label = 0 AND value >= 0) AS genuine_mean FROM lf GROUP BY 1)""",
    ["slop_mean", "genuine_mean"])
add("sign_profile", [RAWN],
    """SELECT label, count(*) AS n_total, count(*) FILTER (WHERE l_quantity < 0) AS n_neg,
      count(*) FILTER (WHERE l_quantity = 0) AS n_zero, count(*) FILTER (WHERE l_quantity > 0) AS n_pos,
      count(*) FILTER (WHERE l_quantity IS NULL) AS n_missing FROM nl GROUP BY 1""")
add("missing_timestamps", [UP_ORD, GAPS, TIM],
    "SELECT count(*) FILTER (WHERE time_interval_std < 0) AS n_missing_timestamps FROM tim")
add("class_stats", [RAWN, NUMC, LONG],
    """SELECT label, feature, avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std
      FROM lf GROUP BY ALL""", ["mean", "median", "std"])
add("class_difference", [RAWN, NUMC, LONG],
    """SELECT *, slop_mean - genuine_mean AS diff, CASE WHEN slop_mean > genuine_mean THEN 'higher'
      WHEN slop_mean < genuine_mean THEN 'lower' ELSE 'equal' END AS verdict FROM (
      SELECT feature, avg(value) FILTER (WHERE label = 0) AS genuine_mean,
        avg(value) FILTER (WHERE label = 1) AS slop_mean FROM lf GROUP BY 1)""",
    ["genuine_mean", "slop_mean", "diff"])


def corr(a: str, b: str, source: str = "nc") -> str:
    return f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS correlation FROM {source}"


_cols = NUM + ["label"]
add("correlation_matrix", [RAWN, NUMC], " UNION ALL ".join(corr(a, b) for a in _cols for b in _cols),
    ["correlation"])
add("label_correlation", [RAWN, NUMC], " UNION ALL ".join(
    f"SELECT '{a}' AS feature, corr({a}, label) AS correlation FROM nc" for a in NUM), ["correlation"])
_all = STATIC_FEATURES + ["sub_to_view_velocity_ratio", "label"]
add("feature_correlation",
    [UP_ORD, GAPS, TIM, CH, TIMED] + DOC
    + [STYLE, vocab(BY_STYLE, WORDS), SIM, features("n_videos_crawled", "n_videos_crawled"),
       "fc AS (SELECT *, CASE WHEN subscriber_velocity > 0 AND vv > 0"
       " THEN log10((subscriber_velocity + 1) / (vv + 1)) ELSE 0.0::DOUBLE END AS sub_to_view_velocity_ratio FROM f)"],
    " UNION ALL ".join(corr(a, b, "fc") for i, a in enumerate(_all) for b in _all[i + 1:]), ["correlation"])
_net = NUM + ["net_price"]
add("high_corr_pairs",
    [RAWN, NUMC, "nx AS (SELECT *, l_extendedprice * (1 - l_discount) AS net_price FROM nc)"],
    "SELECT * FROM (" + " UNION ALL ".join(
        corr(a, b, "nx") for i, a in enumerate(_net) for b in _net[i + 1:])
    + ") WHERE abs(correlation) >= 0.8", ["correlation"])


def hist(source: str, bins: int) -> str:
    return f"""SELECT feature, label, bin, lo + bin * width AS lo, lo + (bin + 1) * width AS hi, n FROM (
      SELECT feature, label, CASE WHEN width = 0 THEN 0 ELSE least(floor((value - lo) / width), {bins - 1}) END::INTEGER AS bin,
        lo, width, count(*) AS n
      FROM {source} JOIN (SELECT feature, min(value) AS lo, (max(value) - min(value)) / {bins}::DOUBLE AS width
        FROM {source} GROUP BY 1) USING (feature) GROUP BY ALL)"""


add("histogram", [RAWN, NUMC, LONG], hist("lf", 30), ["lo", "hi"])
add("boxplot_stats", [RAWN, NUMC, LONG],
    """SELECT feature, label, q1, median, q3, min(value) FILTER (WHERE value BETWEEN a AND b) AS whisker_lo,
      max(value) FILTER (WHERE value BETWEEN a AND b) AS whisker_hi,
      count(*) FILTER (WHERE value < a OR value > b) AS n_outliers
    FROM lf JOIN (SELECT *, q1 - 1.5 * (q3 - q1) AS a, q3 + 1.5 * (q3 - q1) AS b FROM (
      SELECT feature, label, quantile_cont(value, 0.25) AS q1, median(value) AS median,
        quantile_cont(value, 0.75) AS q3 FROM lf GROUP BY ALL)) USING (feature, label)
    GROUP BY ALL""", ["q1", "median", "q3", "whisker_lo", "whisker_hi"])
add("kde", [RAWN, NUMC],
    """SELECT label, i, x, sum(exp(-0.5 * pow((x - v) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density
    FROM (SELECT label, l_quantity AS v FROM nc WHERE l_quantity IS NOT NULL)
    JOIN (SELECT label, count(*)::DOUBLE AS n, stddev_samp(l_quantity) * pow(count(*)::DOUBLE, -0.2) AS h
      FROM nc WHERE l_quantity IS NOT NULL GROUP BY 1) USING (label),
    (SELECT i::INTEGER AS i, lo + i * ((hi - lo) / 199::DOUBLE) AS x FROM range(200) t(i),
      (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM nc))
    GROUP BY label, i, x""", ["x", "density"])

# --- evaluation -----------------------------------------------------------------
PR = """pd AS (SELECT doc_id, toxic AS label, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p1,
  CASE WHEN ((doc_id * 37) % 101) / 100.0::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS prediction, doc_id % 5 AS fold
  FROM labels)"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def metrics(group: str = "") -> str:
    g = f"{group}, " if group else ""
    by = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}tn, fp, fn, tp, {ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy,
      {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS recall,
      {ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (
      SELECT {g}count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
        count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
        count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM pd{by})"""


def auc(group: str = "") -> str:
    """All pairs of a positive and a negative, counted: the definition itself."""
    g = f"a.{group}, " if group else ""
    on = f"a.{group} = b.{group} AND " if group else ""
    by = f" GROUP BY a.{group}" if group else ""
    return f"""SELECT {g}avg(CASE WHEN a.p1 > b.p1 THEN 1.0::DOUBLE WHEN a.p1 = b.p1 THEN 0.5 ELSE 0 END) AS roc_auc
      FROM pd a JOIN pd b ON {on}a.label = 1 AND b.label = 0{by}"""


CUM = """sc AS (SELECT p1, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
  FROM pd GROUP BY 1),
cm AS (SELECT p1, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np,
  sum(neg) OVER () AS nn FROM sc WINDOW w AS (ORDER BY p1 DESC))"""
FIVE = ["accuracy", "precision", "recall", "f1"]
add("confusion_metrics", [PR], metrics(), FIVE)
add("classification_report", [PR, f"m AS ({metrics()})", f"""c AS (
  SELECT '0' AS row, {ratio('tn', 'tn + fn')} AS precision, {ratio('tn', 'tn + fp')} AS recall,
    {ratio('2 * tn', '2 * tn + fn + fp')} AS f1, tn + fp AS support FROM m
  UNION ALL SELECT '1', precision, recall, f1, tp + fn FROM m)"""],
    """SELECT * FROM c
    UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, tn + fp + fn + tp FROM m
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM c
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
      sum(f1 * support) / sum(support), sum(support)::BIGINT FROM c""", ["precision", "recall", "f1"])
add("roc_curve", [PR, CUM],
    """SELECT p1 AS threshold, fp::DOUBLE / nn::DOUBLE AS fpr, tp::DOUBLE / np::DOUBLE AS tpr FROM cm
    UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
    ["threshold", "fpr", "tpr"])
add("roc_auc", [PR], auc(), ["roc_auc"])
add("precision_recall_curve", [PR, CUM],
    "SELECT p1 AS threshold, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / np::DOUBLE AS recall FROM cm",
    ["threshold", "precision", "recall"])
add("average_precision", [PR, CUM],
    "SELECT sum(pos::DOUBLE / np::DOUBLE * (tp::DOUBLE / (tp + fp)::DOUBLE)) AS average_precision FROM cm",
    ["average_precision"])
CV = f"""fm AS ({metrics('fold')}), fa AS ({auc('fold')}),
cv AS (SELECT avg(accuracy) AS cv_accuracy, avg(precision) AS cv_precision, avg(recall) AS cv_recall,
  avg(f1) AS cv_f1, avg(roc_auc) AS cv_roc_auc, stddev_pop(f1) AS cv_f1_std, stddev_pop(roc_auc) AS cv_auc_std
  FROM fm LEFT JOIN fa USING (fold))"""
add("cv_summary", [PR, CV], "SELECT * FROM cv",
    ["cv_accuracy", "cv_precision", "cv_recall", "cv_f1", "cv_roc_auc", "cv_f1_std", "cv_auc_std"])
add("health_flags", [PR, CV],
    f"""SELECT f1 AS test_f1, cv_f1, cv_f1_std, f1 > 0.98 AS suspiciously_good, cv_f1_std > 0.1 AS unstable_folds,
      abs(cv_f1 - f1) > 0.1 AS cv_test_gap FROM ({metrics()}) CROSS JOIN cv""", ["test_f1", "cv_f1", "cv_f1_std"])
NM = "CASE {} WHEN 0 THEN 'genuine' ELSE 'slop' END"
ET = """CASE WHEN label = 0 AND prediction = 1 THEN 'False Positive'
  WHEN label = 1 AND prediction = 0 THEN 'False Negative' ELSE 'Correct' END"""
add("error_crosstab", [PR],
    f"""SELECT {NM.format('label')} AS true_name, count(*) FILTER (WHERE prediction = 0) AS genuine,
      count(*) FILTER (WHERE prediction = 1) AS slop FROM pd WHERE label <> prediction GROUP BY 1""")
add("error_profile", [PR],
    f"""SELECT {ET} AS error_type, count(*) AS n, avg(p1) AS mean_p1, avg(n_chars) AS mean_n_chars
      FROM pd JOIN documents USING (doc_id) GROUP BY 1""", ["mean_p1", "mean_n_chars"])
add("error_samples", [PR],
    f"""SELECT doc_id, p1, 'False Positive' AS error_type FROM pd WHERE {ET} = 'False Positive'
      ORDER BY doc_id LIMIT 5""", ["p1"])
add("error_frame", [PR],
    f"""SELECT doc_id, {NM.format('label')} AS true_name, {NM.format('prediction')} AS pred_name,
      {ET} AS error_type FROM pd""")
add("wrong_score_histogram",
    [PR, "lf AS (SELECT label, 'p1' AS feature, p1 AS value FROM pd WHERE label <> prediction)"],
    hist("lf", 20), ["lo", "hi"])

# --- curation -------------------------------------------------------------------
CAND = f"""cd AS (
  SELECT CASE WHEN q = 0 THEN 'lofi hip hop radio to relax' WHEN q = 1 THEN 'sự thật kinh hoàng về'
      ELSE 'query ' || q END AS query, CASE WHEN q < 6 THEN 'slop' ELSE 'genuine' END AS target, q AS query_order, channel_id AS rank, channel_id,
    CASE WHEN channel_id % 9 = 0 THEN 'Lofi Hip Hop ' || title ELSE title END AS title,
    CASE WHEN channel_id % 2 = 0 THEN '' ELSE 'US' END AS country,
    subscriber_count, video_count, view_count, ((channel_id * 53) % 100) / 100.0::DOUBLE AS p
  FROM (SELECT *, unnest([channel_id % 12, (channel_id * 7) % 12]) AS q FROM ch)),
fo AS (SELECT DISTINCT * REPLACE (CASE WHEN country = '' AND regexp_matches(query, '[{VIETNAMESE_LETTERS}]')
    THEN 'VN' ELSE country END AS country) FROM cd
  QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY query_order, rank) = 1),
tl AS (SELECT o_custkey AS channel_id, o_orderkey AS pos,
  CASE WHEN o_orderkey % 40 = 0 THEN 'Deep Sleep mix' ELSE o_orderpriority END AS title FROM orders),
el AS (SELECT fo.* FROM fo WHERE subscriber_count >= 1000 AND video_count >= 10 AND view_count >= 10000
  AND channel_id IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 3))"""
LOWQ = ", ".join(lit(q) for q in LOW_RESULT_QUERIES)


def excluded(titles: str) -> str:
    return f"""(SELECT fo.channel_id, lower(concat_ws(' ', fo.title, txt)) AS txt FROM fo LEFT JOIN (
      SELECT channel_id, string_agg(title, ' ' ORDER BY pos) AS txt FROM (
        SELECT * FROM {titles} QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY pos) <= 5)
      GROUP BY 1) t USING (channel_id))"""


KW = " OR ".join(f"contains(txt, {lit(k)})" for k in EXCLUDE_KEYWORDS)
EX = f"ex AS (SELECT channel_id, ({KW}) AS excluded FROM {excluded('tl')})"
DEC = """CASE WHEN p >= 0.92 AND (p >= 0.97 OR NOT excluded) THEN 'slop' WHEN p <= 0.15 THEN 'genuine' END"""
add("eligibility", [CH, CAND], "SELECT channel_id, country, query_order FROM el")
add("keyword_exclusion", [CH, CAND, EX], "SELECT channel_id, excluded FROM ex")
add("capped_uploads", [CH, CAND],
    f"""SELECT channel_id, count(*) AS n, min(epoch_us(ts)) AS oldest_us FROM (
      SELECT fo.channel_id, o_orderdate AS ts, query FROM fo JOIN orders ON o_custkey = fo.channel_id
      QUALIFY row_number() OVER (PARTITION BY fo.channel_id ORDER BY o_orderdate DESC)
        <= CASE WHEN query IN ({LOWQ}) THEN 10 ELSE 50 END) GROUP BY 1""")
add("classify_candidates", [CH, CAND, EX],
    f"""SELECT channel_id, {DEC} AS decision, CASE WHEN channel_id % 100 = 0 THEN 'slop'
      WHEN p >= 0.95 THEN 'slop' WHEN p <= 0.05 THEN 'genuine' END AS self_label
      FROM fo JOIN ex USING (channel_id)""")
# one channel after the other: looked at while the target class of its search lacks some
CUR = f"""dd AS (SELECT el.*, {DEC} AS decision FROM el JOIN ex USING (channel_id)),
s1 AS (SELECT *, coalesce(count(*) FILTER (WHERE decision = 'slop') OVER (
    ORDER BY query_order, rank, channel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dd WHERE target = 'slop'),
slop_search AS (SELECT * FROM s1 WHERE before < 50),
s2 AS (SELECT *, (SELECT count(*) FROM slop_search WHERE decision = 'genuine') + coalesce(
    count(*) FILTER (WHERE decision = 'genuine') OVER (
    ORDER BY query_order, rank, channel_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dd WHERE target = 'genuine'),
nw AS (SELECT channel_id, title, decision AS label FROM (
  SELECT * FROM slop_search UNION ALL SELECT * FROM s2 WHERE before < 50) WHERE decision IS NOT NULL)"""
add("curate_quota", [CH, CAND, EX, CUR], "SELECT channel_id, title, label FROM nw")
add("seeds_after_curation", [CH, CAND, EX, CUR],
    """SELECT channel_id, label FROM ch WHERE label = 1
    UNION ALL SELECT channel_id, CASE label WHEN 'slop' THEN 1 ELSE 0 END FROM nw
    WHERE label <> 'slop' OR channel_id NOT IN (SELECT channel_id FROM ch WHERE label = 1)""")

FIRST = """SELECT channel_id, r.day AS day, r.order_id AS order_id FROM (
  SELECT o_custkey AS channel_id, min({batch: CASE WHEN o_orderdate < DATE '1997-01-01' THEN 0
      WHEN o_orderdate < DATE '1999-01-01' THEN 1 ELSE 2 END,
    day: CAST(o_orderdate::DATE - DATE '1970-01-01' AS INTEGER), order_id: o_orderkey}) AS r FROM orders GROUP BY 1)"""
add("keyed_ingest", [], FIRST)
add("stream_first_seen", [], FIRST)
add("stream_late_uploads",
    ["""ends AS (SELECT max(ts) - INTERVAL 1 DAY AS water FROM events)""",
     """late AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, ts < TIMESTAMP '2024-01-15 12:00:00'
       AND date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= water AS is_late, water FROM events, ends)"""],
    """SELECT user_id AS channel_id, epoch_us(day) AS day_us, count(*) AS n_uploads, count(*) FILTER (WHERE is_late) AS n_late,
      day + INTERVAL 1 DAY <= water AS final, CASE WHEN day + INTERVAL 1 DAY <= water THEN count(*) ELSE 0 END AS n_settled
    FROM late GROUP BY user_id, day, water""")
add("stream_score", [CH, CAND.split(",\nel AS")[0], f"""tx AS (SELECT ch.channel_id, lower(concat_ws(' ', ch.title, txt)) AS txt FROM ch LEFT JOIN (
  SELECT channel_id, string_agg(title, ' ' ORDER BY pos) AS txt FROM (
    SELECT * FROM tl QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY pos) <= 5) GROUP BY 1) t USING (channel_id))"""],
    f"SELECT channel_id, ({KW}) AS excluded, TRUE AS consistent FROM tx")
add("curate_with_model", [CH, CAND, EX],
    "SELECT channel_id, excluded, TRUE AS consistent FROM el JOIN ex USING (channel_id)")

SQL["features_bucketed"] = SQL["build_features"]

SQL["opening_repeat_ratio_segmented"] = SQL["opening_repeat_ratio"]
# every token stands between blanks of its own, so words of several syllables match in order
SYLLABLES = " one  of  the | of  the | in  the | de  la | in  der | [^ ]+ "
add("type_token_ratio_segmented", SRC + [r"""sg AS (SELECT channel_id, unnest(regexp_extract_all(
    ' ' || array_to_string(regexp_extract_all(title, '[\p{L}\p{N}_]+'), '  ') || ' ', '(?i)""" + SYLLABLES + """')) AS tok FROM tt)"""],
    """SELECT channel_id, coalesce(r, 0) AS type_token_ratio FROM (SELECT DISTINCT channel_id FROM tt) LEFT JOIN (
      SELECT channel_id, count(DISTINCT tok)::DOUBLE / count(tok) AS r FROM sg GROUP BY 1) USING (channel_id)""", ["type_token_ratio"])
BAYES = [GRAMS.split(",\ndg AS")[0], """ng AS (SELECT gram, lang, count(*) AS n FROM gr WHERE trim(gram) <> '' GROUP BY ALL)""",
         "top AS (SELECT gram FROM ng GROUP BY 1 ORDER BY sum(n) DESC, gram LIMIT 400)",
         "langs AS (SELECT lang, count(*) AS docs FROM documents GROUP BY 1)",
         "cells AS (SELECT lang, gram, coalesce(n, 0) + 1 AS n FROM langs CROSS JOIN top LEFT JOIN ng USING (lang, gram))",
         """wt AS (SELECT lang, gram, round(ln(n / (sum(n) OVER (PARTITION BY lang))::DOUBLE) * 1000000)::BIGINT AS w FROM cells
  UNION ALL SELECT lang, '', round(ln(docs / (sum(docs) OVER ())::DOUBLE) * 1000000)::BIGINT FROM langs)"""]
add("language_bayes_weights", BAYES, "SELECT lang AS language, gram, w AS weight FROM wt")
add("language_bayes", BAYES,
    f"""SELECT d.doc_id AS channel_id, coalesce(b, CASE WHEN {n_of('lower(text)', f'[{VIETNAMESE_LETTERS}]')} >= 3
      THEN 'vi' ELSE 'en' END) AS language FROM documents d LEFT JOIN (
        SELECT doc_id, arg_max(lang, s) AS b FROM (
          SELECT doc_id, wt.lang, sum(w) + (SELECT w FROM wt p WHERE p.gram = '' AND p.lang = wt.lang) AS s
          FROM (SELECT doc_id, gram FROM gr) g JOIN wt ON wt.gram = g.gram AND wt.gram <> '' GROUP BY 1, 2 ORDER BY 2) GROUP BY 1) c
      USING (doc_id)""")
add("sketch_quantiles", [RAWN, NUMC, LONG],
    "SELECT label, feature, count(*) AS n, TRUE AS within FROM lf GROUP BY ALL")

# --- interval forest --------------------------------------------------------------
def forest(least: int, fitted: str = "TRUE") -> list[str]:
    """100 trees over 256 rows each of the intervals that `fitted` names, grown and walked by
    their definition: a row's digest gives its rank for every tree, a node's digest the share
    of its range where it cuts. `scores` has every interval, `shift` what a decision adds."""
    digits = "('0x' || substr(h, {}, 12))::BIGINT"
    return [UP_ORD, GAPS, f"iv AS (SELECT channel_id, seq, days FROM g WHERE n >= {least} AND days <= 365)",
            f"fit AS (SELECT * FROM iv WHERE {fitted})",
            "n AS (SELECT least(256, count(*)) AS size, count(*) AS n_rows FROM fit)",
            f"""hs AS (SELECT days, h, {digits.format(1)} AS u, {digits.format(13)} AS v FROM (
  SELECT days, md5('42:' || channel_id || ':' || seq) AS h FROM fit))""",
            """sample AS (SELECT t, days FROM hs, range(100) trees(t)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY (u + t * v) % 281474976710597, h, days) <= 256)""",
            """nodes(t, node, depth, start, days, low, high, c) AS (
  SELECT t, 1::BIGINT, 0, CAST('-inf' AS DOUBLE), days, min(days) OVER w, max(days) OVER w, count(*) OVER w
  FROM sample WINDOW w AS (PARTITION BY t)
  UNION ALL
  SELECT t, node, depth, start, days, min(days) OVER w, max(days) OVER w, count(*) OVER w FROM (
    SELECT t, 2 * node + (days > cut)::BIGINT AS node, depth + 1 AS depth,
           CASE WHEN days > cut THEN cut ELSE start END AS start, days FROM (
      SELECT *, CASE WHEN raw < high THEN raw ELSE low END AS cut FROM (
        SELECT *, low + (high - low) * (('0x' || substr(md5('42:' || t || ':' || node), 1, 12))::BIGINT
                                        / CAST(281474976710656 AS DOUBLE)) AS raw
        FROM nodes WHERE c > 1 AND low < high AND depth < (SELECT ceil(log2(greatest(size, 2))) FROM n))))
  WINDOW w AS (PARTITION BY t, node))""",
            """path_of AS (SELECT i, CASE WHEN i <= 1 THEN 0 WHEN i = 2 THEN 1
    ELSE 2 * (ln(i - 1) + 0.5772156649015329::DOUBLE) - 2 * (i - 1) / i::DOUBLE END AS e FROM range(257) s(i))""",
            """leaves AS (SELECT DISTINCT t, start, depth + e AS path FROM nodes JOIN path_of ON i = c
  WHERE c = 1 OR low = high OR depth >= (SELECT ceil(log2(greatest(size, 2))) FROM n))""",
            """walked AS (SELECT x.days, sum(path) / 100 AS path
  FROM (SELECT DISTINCT days FROM iv) x JOIN (
    SELECT t, start, path, lead(start, 1, CAST('inf' AS DOUBLE)) OVER (PARTITION BY t ORDER BY start) AS stop FROM leaves) l
  ON x.days > l.start AND x.days <= l.stop GROUP BY 1)""",
            """points AS (SELECT days, round(pow(2::DOUBLE, -path / (SELECT e FROM path_of, n WHERE i = size)), 12) AS score FROM walked)""",
            "scores AS (SELECT channel_id, score FROM iv JOIN points USING (days))",
            """shift AS (SELECT quantile_cont(-score, 0.15) + 0.5::DOUBLE AS shift FROM fit JOIN points USING (days))""",
            """decided AS (SELECT channel_id, avg(score + shift) AS s FROM scores, shift GROUP BY 1)"""]


def add_recursive(name: str, ctes: list[str], body: str, doubles: list[str]) -> None:
    add(name, ["RECURSIVE " + ctes[0], *ctes[1:]], body, doubles)


RAW = """SELECT channel_id, title, label, coalesce(s, 0) AS interval_anomaly_score FROM ch LEFT JOIN (
  SELECT channel_id, avg(CASE WHEN n_rows >= 10 THEN score ELSE 0 END) AS s FROM scores, n GROUP BY 1) USING (channel_id)"""
add_recursive("interval_anomaly", [*forest(3), CH],
              """SELECT channel_id, label, coalesce(s, 0.5::DOUBLE) AS if_anomaly_score
    FROM ch LEFT JOIN decided USING (channel_id)""", ["if_anomaly_score"])
add_recursive("interval_anomaly_raw", [*forest(2), CH], RAW, ["interval_anomaly_score"])
add_recursive("anomaly_by_label", [*forest(2), CH],
              f"SELECT label, avg(interval_anomaly_score) AS mean_score, count(*) AS n FROM ({RAW}) GROUP BY 1", ["mean_score"])

# --- learning: what does not depend on a fitted model's numbers ---------------------
# labelled channels in the seeded order of their label; a fifth is tested, the rest is dealt in five
DEALT = """lab AS (SELECT doc_id AS channel_id, quality AS label, md5('42:' || doc_id) AS h FROM labels
  WHERE doc_id IN (SELECT c_custkey FROM customer)),
split AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, channel_id)
    <= round(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_test FROM lab),
dealt AS (SELECT *, CASE WHEN NOT is_test THEN
    CAST((row_number() OVER (PARTITION BY is_test, label ORDER BY h, channel_id) - 1) % 5 AS INTEGER) END AS fold FROM split)"""
add_recursive("train_rows", [DEALT, *forest(3, "channel_id IN (SELECT channel_id FROM dealt WHERE NOT is_test)")],
              """SELECT channel_id, label, coalesce(fold, -1) AS fold, CASE WHEN is_test THEN coalesce(s, 0.5::DOUBLE) END AS if_anomaly_score,
      TRUE AS consistent FROM dealt LEFT JOIN decided USING (channel_id)""", ["if_anomaly_score"])
add_recursive("score_rows", [CH, *forest(3, "channel_id IN (SELECT doc_id FROM labels)")],
              """SELECT channel_id, coalesce(s, 0.5::DOUBLE) AS if_anomaly_score, TRUE AS consistent
    FROM ch LEFT JOIN decided USING (channel_id)""", ["if_anomaly_score"])
add("compare_rows", [DEALT],
    """SELECT m AS "Model", coalesce(fold, -1) AS fold, count(*) AS n, count(*) FILTER (WHERE label = 1) AS positives, count(*) AS consistent
    FROM dealt, (VALUES ('Logistic Regression'), ('MLP'), ('Random Forest'), ('SVM (RBF)')) v(m) GROUP BY 1, 2""")
add("fitted_scaler", [CH],
    " UNION ALL ".join(f"""SELECT '{c}' AS feature, m AS median, avg(coalesce(x, m)) AS mean, stddev_pop(coalesce(x, m)) AS std
    FROM (SELECT {c}::DOUBLE AS x FROM ch), (SELECT median({c}::DOUBLE) AS m FROM ch) GROUP BY m"""
    for c in ("subscriber_count", "view_count", "video_count", "n_videos_crawled")),
    ["median", "mean", "std"])

add("notebook_rows", [DEALT], "SELECT channel_id, label, TRUE AS consistent FROM dealt WHERE is_test")
add("model_roundtrip", [CH], "SELECT channel_id, TRUE AS same FROM ch")
add("numeric_means", [CH], " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean FROM ch" for c in (
    "channel_id", "subscriber_count", "view_count", "video_count", "n_videos_crawled")), ["mean"])
add("leaderboard",
    [PR, """lm AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS m, nullif(fold, 0) AS f FROM pd)""",
     """lc AS (SELECT m, f, count(*) FILTER (WHERE label = 1 AND prediction = 1)::DOUBLE AS tp,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       count(*) FILTER (WHERE label = prediction)::DOUBLE AS hits, count(*) AS n FROM lm GROUP BY 1, 2)""",
     """l1 AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM lc)""",
     """lt AS (SELECT m AS "Model", round(hits / n, 4) AS "Accuracy", round(pr, 4) AS "Precision", round(rc, 4) AS "Recall",
       round(f1, 4) AS "F1" FROM l1 WHERE f IS NULL)"""],
    """SELECT lt.*, round(a, 4) AS "CV F1 Mean", round(s, 4) AS "CV F1 Std",
      row_number() OVER (ORDER BY "F1" DESC, "Model") = 1 AS is_best
    FROM lt LEFT JOIN (SELECT m, avg(f1) AS a, stddev_pop(f1) AS s FROM l1 WHERE f IS NOT NULL GROUP BY 1) ON m = "Model\"""",
    ["Accuracy", "Precision", "Recall", "F1", "CV F1 Mean", "CV F1 Std"])

# --- streaming ------------------------------------------------------------------
add("stream_ingest", [], "SELECT DISTINCT o_custkey AS channel_id FROM orders")
add("stream_daily_uploads", [],
    """SELECT user_id AS channel_id, epoch_us(date_trunc('day', ts)::TIMESTAMP) AS day_us, count(*) AS n_uploads,
      min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1, 2""")
