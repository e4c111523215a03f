"""Text operators: sentiment, keywords, intents, terms, emotion scores and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as fixed


def _words(text: Column) -> Column:
    """Lower-case words parted by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def sentiment(df: DataFrame, text: str = "text") -> DataFrame:
    """``label`` and ``score`` from the two word lists."""
    out = df.withColumn("_w", _words(F.col(text)))
    hits = lambda ws: F.size(F.filter("_w", lambda w: w.isin(ws)))
    out = out.withColumn("_s", (hits(fixed.POSITIVE) - hits(fixed.NEGATIVE)) / F.greatest(F.lit(1), F.size("_w")))
    s = F.col("_s")
    label = F.when(s > 0.05, "positive").when(s < -0.05, "negative").otherwise("neutral")
    score = F.when(F.abs(s) > 0.05, F.least(F.lit(1.0), 5 * F.abs(s))).otherwise(0.5)
    return out.withColumn("label", label).withColumn("score", score).drop("_w", "_s")


def keywords(df: DataFrame, text: str = "text", top: int = 5) -> DataFrame:
    """The ``top`` longest distinct words of over three characters that are no stop words; ties in alphabetical order."""
    w = F.array_distinct(F.filter(_words(F.col(text)), lambda x: (F.length(x) > 3) & ~x.isin(fixed.STOP_WORDS)))
    ordered = F.array_sort(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w"))))
    return df.withColumn("keywords", F.transform(F.slice(ordered, 1, top), lambda s: s["w"]))


def categories(df: DataFrame, text: str = "text") -> DataFrame:
    """One array column for each category: its words that the text contains."""
    low = F.lower(text)
    cols = {f"cat_{c}": F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w)) for c, ws in fixed.CATEGORIES.items()}
    return df.withColumns(cols)


def _any(low: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t)
    return out


def query_intent(text: Column) -> Column:
    """comparative, recommendation, emotional, technical or unknown; the first that fits."""
    low = F.lower(text)
    every = lambda table: [t for ts in table.values() for t in ts]
    return (
        F.when(_any(low, fixed.COMPARE), "comparative")
        .when(_any(low, fixed.RECOMMEND), "recommendation")
        .when(_any(low, every(fixed.EMOTIONAL_TERMS)), "emotional")
        .when(_any(low, every(fixed.TECHNICAL_TERMS)), "technical")
        .otherwise("unknown")
    )


def _first_synonyms(df: DataFrame, table: dict[str, list[str]], text: str) -> DataFrame:
    """One row per (row, term) whose first contained synonym is ``synonym``; the table is a constant in the row."""
    rows = F.array(*[F.struct(F.lit(t).alias("term"), F.array(*map(F.lit, ss)).alias("ss")) for t, ss in table.items()])
    out = df.withColumn("_low", F.lower(text)).withColumn("_t", F.explode(rows))
    first = F.filter(F.col("_t.ss"), lambda s: F.contains(F.col("_low"), s))
    return out.withColumn("term", F.col("_t.term")).withColumn("synonym", F.get(first, F.lit(0))).where("synonym IS NOT NULL").drop("_t")


def emotional_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (.., term, intensity): .7 unless the word before the synonym changes it; the last modified place wins."""
    out = _first_synonyms(df, fixed.EMOTIONAL_TERMS, text).withColumn("_w", _words(F.col("_low")))
    pairs = F.zip_with(F.col("_w"), F.slice("_w", 2, F.greatest(F.size("_w"), F.lit(1))), lambda a, b: F.struct(a.alias("m"), b.alias("w")))
    names = {m: v for v, ms in fixed.INTENSITY.items() for m in ms}
    fits = F.filter(pairs, lambda p: (p["w"] == F.col("synonym")) & p["m"].isin(list(names)))
    last = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.get(fits, F.size(fits) - 1)["m"])
    return out.withColumn("intensity", F.coalesce(last, F.lit(0.7))).drop("_low", "_w", "synonym")


def technical_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows (.., term, value) with the value that a qualifier before the synonym gives."""
    out = _first_synonyms(df, fixed.TECHNICAL_TERMS, text)
    has = lambda *qs: F.contains(F.col("_low"), F.concat(F.lit(qs[0] + " "), F.col("synonym"))) | F.contains(F.col("_low"), F.concat(F.lit(qs[1] + " "), F.col("synonym")))
    value = F.when(has("high", "strong"), 0.9).when(has("moderate", "medium"), 0.6).when(has("low", "light"), 0.3).otherwise(0.7)
    return out.withColumn("value", value).drop("_low", "synonym")


def _at_most_ten(c: Column) -> Column:
    """Null stays null, which ``least`` would pass over."""
    return F.when(c.isNotNull(), F.least(F.lit(10.0), c))


def _scaled(c: Column, low: float, step: float) -> Column:
    """(c - low) / step held in 0..10."""
    return F.greatest(F.lit(0.0), _at_most_ten((c - low) / step))



def emotion_scores(df: DataFrame) -> DataFrame:
    """Nine scores in 0..10 from feature columns; a null feature contributes nothing.

    Raw features: loudness, tempo, dynamic_range, spectral_centroid, spectral_rolloff,
    spectral_flatness, background_contrast, stereo_width, groove_quality. All other
    terms arrive on the scale of 0 to 10 under the names used in the table.
    """
    f = F.col
    flip = lambda c: 10.0 - c
    bright = _at_most_ten(f("spectral_centroid") / 500)
    terms: dict[str, tuple[float, list[tuple[float, Column]]]] = {
        "energy": (0.0, [(0.4, _at_most_ten(f("loudness") * 10)), (0.3, _scaled(f("tempo"), 60, 12)), (0.1, F.greatest(F.lit(0.0), flip(_at_most_ten(f("dynamic_range") * 5)))), (0.2, f("drum_intensity"))]),
        "brightness": (5.0, [(0.5, bright), (0.3, _at_most_ten(f("spectral_rolloff") / 2000)), (0.2, f("high_freq_energy"))]),
        "tension": (5.0, [(0.3, _at_most_ten(f("spectral_flatness") * 20)), (0.3, f("rhythmic_complexity")), (0.4, f("dissonance"))]),
        "warmth": (5.0, [(0.5, f("low_mid_energy")), (0.3, _at_most_ten(10 - f("background_contrast") * 2)), (0.2, f("harmonic_richness"))]),
        "groove": (5.0, [(0.4, f("microtiming")), (0.3, f("syncopation")), (0.3, f("bass_drum_interaction"))]),
        "aggression": (5.0, [(0.4, f("transient_sharpness")), (0.3, f("distortion")), (0.3, f("high_freq_intensity"))]),
        "atmosphere": (5.0, [(0.4, f("reverb_amount")), (0.3, _at_most_ten(f("stereo_width") * 10)), (0.3, f("background_texture"))]),
        "melancholy": (5.0, [(0.5, f("minor_key")), (0.3, F.greatest(F.lit(0.0), flip(_at_most_ten((f("tempo") - 70) / 10)))), (0.2, f("sparse_arrangement"))]),
        "euphoria": (5.0, [(0.3, flip(f("minor_key"))), (0.4, f("uplifting_progression")), (0.3, bright)]),
    }
    out = {}
    for name, (start, parts) in terms.items():
        total = F.lit(start)
        for weight, c in parts:
            total = total + F.coalesce(weight * c, F.lit(0.0))
        if name == "groove":
            total = F.coalesce(f("groove_quality"), total)
        out[name] = F.least(F.lit(10.0), F.greatest(F.lit(0.0), total))
    return df.withColumns(out)


def emotion_level(long: DataFrame) -> DataFrame:
    """Rows (emotion, value) with ``level`` (below 3 low, below 7 moderate, else high) and the emotion's ``phrase`` for it."""
    names = ("low", "moderate", "high")
    table = F.create_map(*[F.lit(x) for e, ps in fixed.LEVEL_PHRASES.items() for n, p in zip(names, ps, strict=True) for x in (f"{e}/{n}", p)])
    level = F.when(F.col("value") < 3, "low").when(F.col("value") < 7, "moderate").otherwise("high")
    return long.withColumn("level", level).withColumn("phrase", F.coalesce(F.element_at(table, F.concat_ws("/", "emotion", "level")), F.concat_ws(" ", "level", "emotion")))


def overall_mood(df: DataFrame) -> DataFrame:
    return df.withColumn("mood", F.when(F.col("euphoria") > F.col("melancholy"), "uplifting").otherwise("melancholic"))


def track_description(df: DataFrame) -> DataFrame:
    """A sentence from the columns energy, brightness, bpm, key; absent parts are left out."""
    parts = [
        F.when(F.col("energy").isNotNull(), F.format_string("Energy %.1f", "energy")),
        F.when(F.col("brightness").isNotNull(), F.format_string("brightness %.1f", "brightness")),
        F.when(F.col("bpm").isNotNull(), F.format_string("tempo %.1f BPM", "bpm")),
        F.when(F.col("key").isNotNull(), F.concat(F.lit("key "), F.col("key"))),
    ]
    return df.withColumn("description", F.concat(F.concat_ws(", ", *parts), F.lit(".")))


def caption_sentiment(captions: DataFrame, key: str = "clip_id", text: str = "text") -> DataFrame:
    """Per clip the hits of each word list over its captions, and the dominant list (neutral without hits; ties in list order)."""
    low = F.lower(text)
    n = {k: F.size(F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains(low, w))) for k, ws in fixed.CAPTION_WORDS.items()}
    by = captions.select(key, *[c.alias(k) for k, c in n.items()]).groupBy(key).agg(*[F.sum(k).alias(k) for k in n])
    p, q, z = F.col("positive"), F.col("negative"), F.col("neutral")
    top = F.when((p + q + z) == 0, "neutral").when((p >= q) & (p >= z), "positive").when(q >= z, "negative").otherwise("neutral")
    return by.withColumn("dominant", top)


def caption_summary(captions: DataFrame, key: str = "clip_id", order: str = "turn", text: str = "text") -> DataFrame:
    """First caption, two from the middle part (at a third and two thirds of it) and the last, joined; short clips give all.

    Only row numbers decide which captions stay, so no clip's captions are collected whole.
    """
    w = Window.partitionBy(key)
    c = captions.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    m = F.col("_n") - 2
    middle = F.col("_i").isin(-1) | (F.col("_i") == 1 + F.floor(m / 3)) | (F.col("_i") == 1 + F.floor(2 * m / 3))
    kept = c.where((F.col("_n") <= 4) | (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1) | middle)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", text))), lambda s: s[text]), " ").alias("summary"))


def section_split(lines: DataFrame, header: str, key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines with the number and title of their section; what precedes the first header goes."""
    w = Window.partitionBy(key).orderBy(order)
    is_header = F.trim(text).rlike(header)
    out = lines.withColumn("_h", is_header.cast("int")).withColumn("section", F.sum("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("title", F.last(F.when(F.col("_h") == 1, F.trim(text)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where("section > 0 AND _h = 0").drop("_h")


def reference_lines(lines: DataFrame, key: str = "doc_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Numbered lines ``[n] ..`` after a line that reads references."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("_in", F.max((F.lower(F.trim(text)) == "references").cast("int")).over(w))
    return out.where((F.col("_in") == 1) & F.col(text).rlike(r"^\[\d+\]")).withColumn("number", F.regexp_extract(text, r"^\[(\d+)\]", 1).cast("int")).drop("_in")


def index_track(features: DataFrame, embeddings: DataFrame, key: str = "track_id") -> DataFrame:
    """Index rows: embedding (computed elsewhere), description and emotion scores of each track."""
    scored = track_description(emotion_scores(features))
    return embeddings.join(scored, key)
