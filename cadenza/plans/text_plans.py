"""Queries T1 to T13."""

from pyspark.sql import functions as F

from ..functions import text as op
from ..functions import words as fixed
from ..schemas import table
from .aggregates_plans import rounded
from .common import Plans

PLANS = Plans()
add = PLANS.add


def lst(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_W = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
#: The tables' prose is invented, so the queries read it with a few of its own frequent words set to list words.
_SWAP = {"the": "great", "que": "bad", "und": "dark", "that": "bass", "les": "compare", "with": "very bright"}


def _prose(df, text="text"):
    out = F.lower(text)
    for a, b in _SWAP.items():
        out = F.regexp_replace(out, rf"(^|\s){a}(\s|$)", f"$1{b}$2")
    return df.withColumn(text, out)


def _prose_sql(table_name, cols):
    out = "lower(text)"
    for a, b in _SWAP.items():
        out = rf"regexp_replace({out}, '(^|\s){a}(\s|$)', '\1{b}\2', 'g')"
    return f"prose AS (SELECT {cols}, {out} AS text FROM {table_name})"


DOCS = _prose_sql("documents", "doc_id")
TURNS = _prose_sql("conversations", "conv_id, turn, role")


def docs(spark, d):
    return _prose(table(spark, d, "documents").select("doc_id", "text"))


def turns(spark, d):
    return _prose(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"))


@add("t1_sentiment", f"""WITH {DOCS}, w AS (SELECT doc_id, {_W} AS w FROM prose), s AS (SELECT doc_id, (len(list_filter(w, lambda x: list_contains({lst(fixed.POSITIVE)}, x))) - len(list_filter(w, lambda x: list_contains({lst(fixed.NEGATIVE)}, x)))) / greatest(1, len(w)) AS s FROM w)
SELECT doc_id, CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN abs(s) > 0.05 THEN least(1.0, 5*abs(s)) ELSE 0.5 END, 6) AS score FROM s""")
def t1(spark, d):
    return rounded(op.sentiment(docs(spark, d)).select("doc_id", "label", "score"))


@add("t2_keywords", f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), x AS (SELECT DISTINCT doc_id, unnest(w) AS k FROM w), r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY length(k) DESC, k) AS rn FROM x WHERE length(k) > 3 AND NOT list_contains({lst(fixed.STOP_WORDS)}, k)),
g AS (SELECT doc_id, string_agg(k, '|' ORDER BY rn) AS keywords FROM r WHERE rn <= 5 GROUP BY doc_id) SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN g USING (doc_id)""")
def t2(spark, d):
    return op.keywords(table(spark, d, "documents")).select("doc_id", F.array_join("keywords", "|").alias("keywords"))


@add("t3_categories", f"WITH {DOCS} SELECT doc_id, " + ", ".join(f"array_to_string(list_filter({lst(ws)}, lambda w: contains(text, w)), ',') AS cat_{c}" for c, ws in fixed.CATEGORIES.items()) + " FROM prose")
def t3(spark, d):
    out = op.categories(docs(spark, d))
    return out.select("doc_id", *[F.array_join(f"cat_{c}", ",").alias(f"cat_{c}") for c in fixed.CATEGORIES])


def _has(terms):
    return "(" + " OR ".join(f"contains(text, '{t}')" for t in terms) + ")"


_EVERY = {k: [t for ts in v.values() for t in ts] for k, v in (("e", fixed.EMOTIONAL_TERMS), ("t", fixed.TECHNICAL_TERMS))}


@add("t4_query_intent", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN {_has(fixed.COMPARE)} THEN 'comparative' WHEN {_has(fixed.RECOMMEND)} THEN 'recommendation' WHEN {_has(_EVERY['e'])} THEN 'emotional'
  WHEN {_has(_EVERY['t'])} THEN 'technical' ELSE 'unknown' END AS intent FROM prose WHERE role = 'user'""")
def t4(spark, d):
    return turns(spark, d).where("role = 'user'").select("conv_id", "turn", op.query_intent(F.col("text")).alias("intent"))


def _terms_sql(terms):
    return "tt AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {lst(ss)})" for t, ss in terms.items()) + ") v(term, ss))"


_MODS = "CASE " + " ".join(f"WHEN m IN ({', '.join(repr(m) for m in ms)}) THEN {v}" for v, ms in fixed.INTENSITY.items()) + " END"


@add("t5_emotional_terms", f"""WITH {TURNS}, {_terms_sql(fixed.EMOTIONAL_TERMS)}, f AS (SELECT conv_id, turn, text, term, list_filter(ss, lambda s: contains(text, s))[1] AS syn FROM prose CROSS JOIN tt WHERE role='user'),
w AS (SELECT conv_id, turn, term, syn, {_W} AS w FROM f WHERE syn IS NOT NULL), x AS (SELECT conv_id, turn, term, syn, unnest(w) AS wd, unnest(list_prepend('', w[1:-2])) AS m, unnest(range(1, len(w)+1)) AS i FROM w),
y AS (SELECT conv_id, turn, term, arg_max({_MODS}, i) AS v FROM x WHERE wd = syn AND {_MODS} IS NOT NULL GROUP BY ALL)
SELECT conv_id, turn, term, coalesce(v, 0.7)::DOUBLE AS intensity FROM w LEFT JOIN y USING (conv_id, turn, term)""")
def t5(spark, d):
    return op.emotional_terms(turns(spark, d).where("role = 'user'")).select("conv_id", "turn", "term", "intensity")


@add("t6_technical_terms", f"""WITH {TURNS}, {_terms_sql(fixed.TECHNICAL_TERMS)}, f AS (SELECT conv_id, turn, text, term, list_filter(ss, lambda s: contains(text, s))[1] AS syn FROM prose CROSS JOIN tt WHERE role='user')
SELECT conv_id, turn, term, (CASE WHEN contains(text, 'high '||syn) OR contains(text, 'strong '||syn) THEN 0.9 WHEN contains(text, 'moderate '||syn) OR contains(text, 'medium '||syn) THEN 0.6
  WHEN contains(text, 'low '||syn) OR contains(text, 'light '||syn) THEN 0.3 ELSE 0.7 END)::DOUBLE AS value FROM f WHERE syn IS NOT NULL""")
def t6(spark, d):
    return op.technical_terms(turns(spark, d).where("role = 'user'")).select("conv_id", "turn", "term", "value")


_RAW = {
    "loudness": "l_discount * 8", "tempo": "60 + l_quantity * 2", "dynamic_range": "l_tax * 20", "spectral_centroid": "l_extendedprice / 20", "spectral_rolloff": "l_extendedprice / 8",
    "spectral_flatness": "l_discount", "background_contrast": "l_tax * 40", "stereo_width": "l_discount * 5", "drum_intensity": "l_quantity / 5", "high_freq_energy": "l_tax * 100", "rhythmic_complexity": "l_quantity / 10",
    "dissonance": "l_discount * 10", "low_mid_energy": "l_tax * 10", "harmonic_richness": "l_quantity / 25", "microtiming": "l_discount * 3", "syncopation": "l_tax * 30", "bass_drum_interaction": "l_quantity / 50",
    "transient_sharpness": "l_discount * 20", "distortion": "l_tax * 5", "high_freq_intensity": "l_quantity / 100", "reverb_amount": "l_discount * 4", "background_texture": "l_tax * 9", "minor_key": "l_quantity / 6",
    "sparse_arrangement": "l_discount * 7", "uplifting_progression": "l_tax * 8",
}
_IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def features(spark, d):
    li = table(spark, d, "lineitem").withColumns({k: F.expr(v) for k, v in _RAW.items()})
    return li.withColumn("groove_quality", F.when(F.col("l_linenumber") == 1, F.col("l_quantity") / 5)).withColumn("tempo", F.when(F.col("l_linenumber") != 2, F.col("tempo")))


_FEATURES = "f AS (SELECT *, CASE WHEN l_linenumber=1 THEN l_quantity/5 END AS groove_quality FROM (SELECT " + ", ".join(_IDS) + ", l_quantity, " + ", ".join(f"CASE WHEN l_linenumber<>2 THEN {v} END AS {k}" if k == "tempo" else f"{v} AS {k}" for k, v in _RAW.items()) + " FROM lineitem))"
_SCORES = _FEATURES + """, e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 0.4*least(10, loudness*10) + coalesce(0.3*least(10, greatest(0, (tempo-60)/12)), 0) + 0.1*greatest(0, 10-least(10, dynamic_range*5)) + 0.2*drum_intensity AS energy,
 5 + 0.5*least(10, spectral_centroid/500) + 0.3*least(10, spectral_rolloff/2000) + 0.2*high_freq_energy AS brightness,
 5 + 0.3*least(10, spectral_flatness*20) + 0.3*rhythmic_complexity + 0.4*dissonance AS tension,
 5 + 0.5*low_mid_energy + 0.3*least(10, 10-background_contrast*2) + 0.2*harmonic_richness AS warmth,
 coalesce(groove_quality, 5 + 0.4*microtiming + 0.3*syncopation + 0.3*bass_drum_interaction) AS groove,
 5 + 0.4*transient_sharpness + 0.3*distortion + 0.3*high_freq_intensity AS aggression,
 5 + 0.4*reverb_amount + 0.3*least(10, stereo_width*10) + 0.3*background_texture AS atmosphere,
 5 + 0.5*minor_key + coalesce(0.3*greatest(0, 10-least(10, (tempo-70)/10)), 0) + 0.2*sparse_arrangement AS melancholy,
 5 + 0.3*(10-minor_key) + 0.4*uplifting_progression + 0.3*least(10, spectral_centroid/500) AS euphoria FROM f)"""
_EMO = list(fixed.LEVEL_PHRASES)


@add("t7_emotion_scores", f"WITH {_SCORES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round(least(10.0, greatest(0.0, {e})), 9) AS {e}" for e in _EMO) + " FROM e")
def t7(spark, d):
    return op.emotion_scores(features(spark, d)).select(*_IDS, *[F.round(e, 9).alias(e) for e in _EMO])


@add("t8_emotion_level", "WITH l AS (SELECT p_partkey, unnest(['energy','groove','unknown']) AS emotion, p_size / 5.0 AS value FROM part), v AS (SELECT *, CASE WHEN value < 3 THEN 'low' WHEN value < 7 THEN 'moderate' ELSE 'high' END AS level FROM l) SELECT p_partkey, emotion, level, CASE " + " ".join(f"WHEN emotion='{e}' AND level='{n}' THEN '{p}'" for e in ("energy", "groove") for n, p in zip(("low", "moderate", "high"), fixed.LEVEL_PHRASES[e])) + " ELSE level || ' ' || emotion END AS phrase FROM v")
def t8(spark, d):
    long = table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, ["energy", "groove", "unknown"]))).alias("emotion"), (F.col("p_size") / 5.0).alias("value"))
    return op.emotion_level(long).select("p_partkey", "emotion", "level", "phrase")


@add("t8_overall_mood", f"WITH {_SCORES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN least(10,greatest(0,euphoria)) > least(10,greatest(0,melancholy)) THEN 'uplifting' ELSE 'melancholic' END AS mood FROM e")
def t8b(spark, d):
    return op.overall_mood(op.emotion_scores(features(spark, d))).select(*_IDS, "mood")


@add("t9_track_description", """SELECT p_partkey, 'Energy ' || printf('%.1f', p_size * 1.0) || ', brightness ' || printf('%.1f', p_partkey * 1.0) || CASE WHEN p_size > 20 THEN ', tempo ' || printf('%.1f', p_retailprice) || ' BPM' ELSE '' END || ', key ' || p_brand || '.' AS description FROM part""")
def t9(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("energy"), F.col("p_partkey").cast("double").alias("brightness"), F.when(F.col("p_size") > 20, F.col("p_retailprice")).alias("bpm"), F.col("p_brand").alias("key"))
    return op.track_description(p).select("p_partkey", "description")


@add("t10_caption_sentiment", f"WITH {TURNS}, c AS (SELECT conv_id, " + ", ".join(f"CAST(sum(len(list_filter({lst(ws)}, lambda w: contains(text, w)))) AS BIGINT) AS {k}" for k, ws in fixed.CAPTION_WORDS.items()) + """ FROM prose GROUP BY conv_id)
SELECT conv_id, positive, negative, neutral, CASE WHEN positive+negative+neutral = 0 THEN 'neutral' WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END AS dominant FROM c""")
def t10(spark, d):
    return op.caption_sentiment(turns(spark, d), "conv_id")


@add("t11_caption_summary", """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, string_agg(text, ' ' ORDER BY i) AS summary FROM c WHERE n <= 4 OR i = 0 OR i = n-1 OR i = 1 + floor((n-2)/3.0) OR i = 1 + floor(2*(n-2)/3.0) GROUP BY conv_id""")
def t11(spark, d):
    return op.caption_summary(table(spark, d, "conversations"), "conv_id")


_HEADER = r"^[A-Z][a-zà-ÿ]*( [a-zà-ÿ]+)?[.]$"


@add("t12_section_split", rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10)))+1)) AS line_no FROM documents),
s AS (SELECT *, CASE WHEN regexp_matches(trim(line), '{_HEADER}') THEN 1 ELSE 0 END AS hd FROM l), t AS (SELECT *, sum(hd) OVER w AS section, last_value(CASE WHEN hd=1 THEN trim(line) END IGNORE NULLS) OVER w AS title FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(section AS BIGINT) AS section, title, line FROM t WHERE section > 0 AND hd = 0""")
def t12(spark, d):
    return op.section_split(_lines(spark, d), _HEADER).select("doc_id", "line_no", "section", "title", "line")


def _lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return docs.select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


@add("t12_reference_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10)))+1)) AS line_no FROM documents),
m AS (SELECT doc_id, line_no, CASE WHEN line_no = 2 THEN 'References' WHEN line_no > 2 THEN '[' || line_no || '] ' || line ELSE line END AS line FROM l)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(line_no AS INTEGER) AS number FROM m WHERE line_no > 2""")
def t12b(spark, d):
    n = F.col("line_no")
    marked = _lines(spark, d).withColumn("line", F.when(n == 2, "References").when(n > 2, F.concat(F.lit("["), n, F.lit("] "), F.col("line"))).otherwise(F.col("line")))
    return op.reference_lines(marked).select("doc_id", "line_no", "number")


@add("t13_index_track")
def t13(spark, d):
    f = features(spark, d).groupBy((F.col("l_orderkey") % 500).alias("track_id")).agg(*[F.avg(k).alias(k) for k in [*_RAW, "groove_quality"]])
    f = f.withColumn("bpm", F.col("tempo")).withColumn("key", F.lit("C"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("track_id"), F.size("embedding").alias("dims"))
    return op.index_track(op.emotion_scores(f), e).select("track_id", "dims", "description", *[F.round(x, 6).alias(x) for x in _EMO])
