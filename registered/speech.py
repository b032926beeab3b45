"""Speech operators on conversations, acoustic rows, samples and cycle lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oracles.views import cte, stmt
from registered import Family
from registered import sources as SRC
from wardwatch.bridge import views as V
from wardwatch.functions.guards import dbl
from wardwatch.operators import speech as SP
from wardwatch.sources import recordings as REC

fam = Family()
NS = 0.45
RATE, LOW, HIGH = 0.5, 0.02, 0.25
NORM = "strip_accents(lower({0}))"

cte(
    "transcripts",
    """SELECT recording_id, string_agg(text, '' ORDER BY seg_idx) AS text, avg(no_speech_prob) AS avg_no_speech,
    regexp_matches(string_agg(text, '' ORDER BY seg_idx), '\\S') AND avg(no_speech_prob) <= 0.45::DOUBLE AS reliable FROM segments GROUP BY 1""",
    "segments",
)
TERMLIST = "(VALUES (0, 'la'), (1, 'que'), (2, 'ing'), (3, 'of the'), (4, 'entre')) AS t(ord, term)"
cte(
    "hits",
    f"""SELECT recording_id, ord, term, text, (sum(len(p)) OVER w + (i - 1) * len(term))::BIGINT AS char_at FROM (
      SELECT recording_id, text, ord, term, i, parts[i] AS p, len(parts) AS n FROM (
        SELECT recording_id, text, ord, term, string_split({NORM.format('text')}, term) AS parts FROM transcripts, {TERMLIST}), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
    WHERE i < n WINDOW w AS (PARTITION BY recording_id, ord ORDER BY i ROWS UNBOUNDED PRECEDING)""",
    "transcripts",
)
cte(
    "spans",
    """SELECT recording_id, start_s, (sum(len(text)) OVER w - len(text))::BIGINT AS s, (sum(len(text)) OVER w)::BIGINT AS e FROM segments
    WINDOW w AS (PARTITION BY recording_id ORDER BY seg_idx ROWS UNBOUNDED PRECEDING)""",
    "segments",
)
MOOD = """SELECT recording_id, reliable, CASE WHEN p + n = 0 THEN 'neutral' WHEN abs((p - n) / (p + n)::DOUBLE) < 0.2::DOUBLE THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS label,
    CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE (p - n) / (p + n)::DOUBLE END AS score FROM (
    SELECT recording_id, reliable, len(list_filter(words, lambda w: w IN ('the', 'le', 'die', 'el'))) AS p, len(list_filter(words, lambda w: w IN ('of', 'ou', 'und', 'la'))) AS n
    FROM (SELECT recording_id, reliable, regexp_extract_all({0}, '[a-z]+') AS words FROM transcripts))""".replace("{0}", NORM.format("text"))
cte("mood", MOOD, "transcripts")


def transcripts(spark, sf) -> DataFrame:
    return SP.assemble_transcript(V.segments(spark, sf), NS)


def hits(spark, sf) -> DataFrame:
    return SP.find_terms_in_segments(V.segments(spark, sf), V.TERMS)


@fam.add(
    "spk_assemble_transcript",
    stmt("SELECT recording_id, md5(text) AS text_md5, len(text)::INTEGER AS n_chars, round(avg_no_speech, 6) AS avg_no_speech, reliable FROM transcripts", "transcripts"),
)
def _assemble(spark, sf):
    return transcripts(spark, sf).select(
        "recording_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), F.round("avg_no_speech", 6).alias("avg_no_speech"), "reliable"
    )


@fam.add("spk_normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS normalized_md5, len({NORM.format('text')})::INTEGER AS n FROM documents")
def _norm(spark, sf):
    n = SP.normalize(F.col("text"))
    return V.table(spark, sf, "documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).alias("n"))


@fam.add(
    "spk_find_terms",
    stmt(
        """SELECT recording_id, term, char_at, substr(text, greatest(char_at - 40, 0) + 1, least(char_at + len(term) + 40, len(text)) - greatest(char_at - 40, 0)) AS context FROM hits""",
        "hits",
    ),
)
def _find(spark, sf):
    return hits(spark, sf).select("recording_id", "term", "char_at", "context")


@fam.add(
    "spk_find_terms_documents",
    f"""SELECT doc_id, term, count(*) AS n, min(pos)::BIGINT AS first_at, max(pos)::BIGINT AS last_at FROM (
      SELECT doc_id, term, sum(len(p)) OVER w + (i - 1) * len(term) AS pos, i, n FROM (
        SELECT doc_id, term, i, parts[i] AS p, len(parts) AS n FROM (SELECT doc_id, term, string_split({NORM.format('text')}, term) AS parts FROM documents, {TERMLIST}),
          LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))
      WINDOW w AS (PARTITION BY doc_id, term ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE i < n GROUP BY 1, 2""",
)
def _find_docs(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("recording_id"), "text")
    found = SP.find_terms(docs, V.TERMS)
    return found.groupBy(F.col("recording_id").alias("doc_id"), "term").agg(
        F.count(F.lit(1)).alias("n"), F.min("char_at").alias("first_at"), F.max("char_at").alias("last_at")
    )


@fam.add(
    "spk_term_timestamp",
    stmt(
        """SELECT h.recording_id, term, char_at, s.start_s AS approx_timestamp_s FROM hits h LEFT JOIN spans s ON s.recording_id = h.recording_id AND char_at >= s.s AND char_at < s.e""",
        "hits",
        "spans",
    ),
)
def _stamp(spark, sf):
    out = SP.term_timestamp(hits(spark, sf), V.segments(spark, sf))
    return out.select("recording_id", "term", "char_at", "approx_timestamp_s")


@fam.add(
    "spk_highlight_term",
    f"""SELECT conv_id, turn, md5(CASE WHEN pos > 0 THEN text[:pos - 1] || '**' || substr(text, pos, 3) || '**' || substr(text, pos + 3) ELSE text END) AS shown
    FROM (SELECT *, instr({NORM.format('text')}, 'que') AS pos FROM conversations)""",
)
def _highlight(spark, sf):
    c = V.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(SP.highlight_term(F.col("text"), "QUÊ")).alias("shown"))


@fam.add("spk_lexicon_sentiment", stmt("SELECT recording_id, label, round(score, 6) AS score FROM mood", "mood"))
def _mood(spark, sf):
    m = SP.lexicon_sentiment(F.col("text"), V.POSITIVE, V.NEGATIVE)
    return transcripts(spark, sf).select("recording_id", m.alias("m")).select("recording_id", "m.label", F.round("m.score", 6).alias("score"))


Z = "CASE WHEN stddev_pop({0}) OVER r = 0 THEN 0 ELSE ({0} - avg({0}) OVER r) / stddev_pop({0}) OVER r END"


@fam.add(
    "spk_fatigue_relative",
    stmt(
        f"""SELECT *, score > 0.5 AS fatigued FROM (SELECT run_id, recording_id, round(({Z.format('jitter_local')} + {Z.format('shimmer_local')} - {Z.format('hnr_db')}
        + {Z.format('pause_rate')} - {Z.format('speaking_rate_wps')}) / 5.0, 5) AS score FROM acoustic WINDOW r AS (PARTITION BY run_id))""",
        "acoustic",
    ),
)
def _fatigue(spark, sf):
    out = SP.fatigue_relative(V.acoustic(spark, sf), 0.5)
    score = F.round("score", 5)
    return out.select("run_id", "recording_id", score.alias("score"), (score > dbl(0.5)).alias("fatigued"))


@fam.add(
    "spk_fatigue_absolute",
    stmt(
        """SELECT run_id, recording_id, (jitter_local > 0.0104::DOUBLE)::INT + (shimmer_local > 0.0381::DOUBLE)::INT + (hnr_db < 15)::INT >= 2 AS fatigued,
        concat_ws(',', CASE WHEN jitter_local > 0.0104::DOUBLE THEN 'high_jitter' END, CASE WHEN shimmer_local > 0.0381::DOUBLE THEN 'high_shimmer' END,
          CASE WHEN hnr_db < 15 THEN 'low_hnr' END) AS indicators FROM acoustic""",
        "acoustic",
    ),
)
def _absolute(spark, sf):
    out = V.acoustic(spark, sf).withColumn("f", SP.fatigue_absolute())
    return out.select("run_id", "recording_id", "f.fatigued", F.array_join("f.indicators", ",").alias("indicators"))


@fam.add(
    "spk_pause_and_rate",
    stmt(
        """SELECT recording_id, round(greatest(d - v, 0) / d, 6) AS pause_rate, round(CASE WHEN v > 0 THEN w / v ELSE 0.0 END, 6) AS speaking_rate_wps FROM (
        SELECT s.recording_id, max(end_s) AS d, sum((len(s.text) % 9)::DOUBLE) AS v, max(len(regexp_extract_all(t.text, '\\S+'))) AS w
        FROM segments s JOIN transcripts t USING (recording_id) GROUP BY 1)""",
        "segments",
        "transcripts",
    ),
)
def _pause(spark, sf):
    seg = V.segments(spark, sf)
    voiced = seg.select("recording_id", "start_s", (F.col("start_s") + (F.length("text") % 9).cast("double")).alias("end_s"))
    length = seg.groupBy("recording_id").agg(F.max("end_s").alias("duration_s"))
    out = SP.pause_and_rate(voiced, transcripts(spark, sf).select("recording_id", "text").join(length, "recording_id"))
    return out.select("recording_id", F.round("pause_rate", 6).alias("pause_rate"), F.round("speaking_rate_wps", 6).alias("speaking_rate_wps"))


cte(
    "envelope",
    """SELECT record_id, k, sqrt(sum(x * x) / 4.0::DOUBLE) AS energy FROM samples JOIN (
      SELECT record_id AS rid, unnest(range(0, (count(*) - 4) // 2 + 1)) AS k FROM samples GROUP BY 1 HAVING count(*) >= 4)
    ON rid = record_id AND idx >= 2 * k AND idx < 2 * k + 4 GROUP BY record_id, k""",
    "samples",
)
cte(
    "periods",
    """SELECT s.record_id, s.n, CASE WHEN n >= 10 AND z > 0 AND least(n - 1, 25) > 2 AND c / z >= 0.3 THEN lag / 0.5::DOUBLE END AS period_s FROM (
      SELECT record_id, n, sum(v * v) AS z FROM centred GROUP BY 1, 2) s LEFT JOIN (
      SELECT a.record_id, b.k - a.k AS lag, sum(a.v * b.v) AS c FROM centred a JOIN centred b ON a.record_id = b.record_id AND b.k - a.k >= 2 AND b.k - a.k < least(a.n - 1, 25)
      GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.record_id ORDER BY sum(a.v * b.v) DESC, b.k - a.k) = 1) c USING (record_id)""",
)
cte("centred", "SELECT record_id, k, energy - avg(energy) OVER (PARTITION BY record_id) AS v, count(*) OVER (PARTITION BY record_id) AS n FROM envelope", "envelope")
from oracles.views import CTES  # noqa: E402

CTES["periods"] = (("centred",), CTES["periods"][1])


def periods(spark, sf) -> DataFrame:
    return SP.dominant_period(SP.energy_envelope(V.samples(spark, sf), 4, 2), RATE, LOW, HIGH)


@fam.add("spk_energy_envelope", stmt("SELECT record_id, k, round(energy, 6) AS energy FROM envelope", "envelope"))
def _envelope(spark, sf):
    return SP.energy_envelope(V.samples(spark, sf), 4, 2).withColumn("energy", F.round("energy", 6))


@fam.add("spk_dominant_period", stmt("SELECT record_id, n, period_s FROM periods", "periods"))
def _period(spark, sf):
    return periods(spark, sf)


@fam.add(
    "spk_respiratory_pattern",
    stmt(
        """SELECT record_id, n >= 20 AND (period_s IS NOT NULL OR r > 0.6::DOUBLE) AS detected, CASE WHEN n >= 20 THEN printf('%.1f', 60.0::DOUBLE / period_s)::DOUBLE END AS breath_rate_bpm,
        CASE WHEN n < 20 THEN 0.0::DOUBLE WHEN period_s IS NOT NULL THEN printf('%.2f', least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * r))::DOUBLE WHEN r > 0.6::DOUBLE THEN printf('%.2f', r)::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
        CASE WHEN n < 20 THEN 'audio too short' WHEN period_s IS NOT NULL THEN 'envelope autocorrelation (period=' || printf('%.2f', period_s) || 's)'
          WHEN r > 0.6::DOUBLE THEN 'energy mostly in the low band' ELSE 'no respiratory pattern' END AS method FROM (SELECT *, (n % 11) / 10.0::DOUBLE AS r FROM periods)""",
        "periods",
    ),
)
def _pattern(spark, sf):
    out = periods(spark, sf).withColumn("r", (F.col("n") % 11) / dbl(10))
    return out.select("record_id", SP.respiratory_pattern(F.col("n"), F.col("period_s"), F.col("r")).alias("p")).select("record_id", "p.*")


def consult_rows(spark, sf) -> DataFrame:
    a = V.acoustic(spark, sf)
    return a.select(
        "recording_id",
        F.col("run_id"),
        F.floor(F.col("speaking_rate_wps")).cast("int").alias("raw"),
        (F.col("hnr_db") < 15).alias("fatigued"),
        (F.col("shimmer_local") > dbl(0.045)).alias("pattern"),
        (F.col("shimmer_local") * dbl(10)).alias("confidence"),
        F.when(F.col("run_id") == "A", "positive").otherwise("neutral").alias("sentiment"),
        (F.col("jitter_local") > 0).alias("reliable"),
    ).withColumn("hits", F.greatest(F.lit(0), F.col("raw") - 4))


cte(
    "consults",
    """SELECT recording_id, run_id, greatest(0, speaking_rate_wps::INT - 4) AS hits, hnr_db < 15 AS fatigued, shimmer_local > 0.045::DOUBLE AS pattern,
    shimmer_local * 10.0::DOUBLE AS confidence, CASE WHEN run_id = 'A' THEN 'positive' ELSE 'neutral' END AS sentiment, jitter_local > 0 AS reliable FROM acoustic""",
    "acoustic",
)


@fam.add(
    "spk_consult_severity",
    stmt(
        """SELECT recording_id, run_id, CASE WHEN hits > 0 AND fatigued THEN 'HIGH' WHEN hits > 0 OR fatigued THEN 'MEDIUM' WHEN pattern AND confidence >= 0.5 THEN 'LOW' ELSE 'INFO' END AS severity,
        CASE WHEN hits > 0 AND fatigued THEN 'critical_terms_and_fatigue' WHEN hits > 0 THEN 'critical_terms' WHEN fatigued THEN 'vocal_fatigue'
          WHEN pattern AND confidence >= 0.5 THEN 'respiratory_pattern' WHEN sentiment <> 'neutral' THEN 'sentiment' ELSE 'speech_analysis' END AS event_type,
        CASE WHEN hits > 0 OR fatigued THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN hits > 0 OR fatigued OR pattern THEN 'positive' ELSE 'negative' END AS status FROM consults""",
        "consults",
    ),
)
def _severity(spark, sf):
    c = consult_rows(spark, sf)
    s = SP.consult_severity(*[F.col(x) for x in ["hits", "fatigued", "pattern", "confidence", "sentiment"]])
    return c.select("recording_id", "run_id", s.alias("s")).select("recording_id", "run_id", "s.*")


@fam.add(
    "spk_consult_score",
    stmt(
        """SELECT recording_id, run_id, round(CASE WHEN reliable THEN greatest(CASE WHEN hits > 0 THEN 0.5 + least(hits * 0.1, 0.5) ELSE 0 END, CASE WHEN fatigued THEN 0.7 ELSE 0 END,
        CASE WHEN pattern AND confidence >= 0.5 THEN 0.3 ELSE 0 END)::DOUBLE WHEN pattern AND confidence >= 0.3 THEN 0.3::DOUBLE END, 6) AS score FROM consults""",
        "consults",
    ),
)
def _score(spark, sf):
    c = consult_rows(spark, sf)
    s = SP.consult_score(*[F.col(x) for x in ["reliable", "hits", "fatigued", "pattern", "confidence"]])
    return c.select("recording_id", "run_id", F.round(s, 6).alias("score"))


@fam.add(
    "spk_cycle_label",
    """SELECT crackle, wheeze, CASE WHEN crackle NOT IN ('0', '1') OR wheeze NOT IN ('0', '1') THEN NULL WHEN crackle = '1' AND wheeze = '1' THEN 'both' WHEN crackle = '1' THEN 'crackle'
    WHEN wheeze = '1' THEN 'wheeze' ELSE 'normal' END AS label, count(*) AS n FROM (SELECT (l_linenumber % 3)::VARCHAR AS crackle, (l_suppkey % 2)::VARCHAR AS wheeze FROM lineitem) GROUP BY ALL""",
)
def _label(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("string").alias("crackle"), (F.col("l_suppkey") % 2).cast("string").alias("wheeze")
    )
    return li.groupBy("crackle", "wheeze", REC.cycle_label(F.col("crackle"), F.col("wheeze")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def patient_cycles(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("P"), (F.col("vec_id") % 37).cast("string")).alias("patient_id"),
        F.concat(F.lit("r"), (F.col("vec_id") % 37).cast("string")).alias("record_id"),
        F.col("vec_id").alias("cycle_index"),
        F.col("vec_id").cast("double").alias("start_s"),
        (F.col("vec_id") + 1).cast("double").alias("end_s"),
        F.when(F.col("label") < 5, "normal").when(F.col("label") < 7, "crackle").when(F.col("label") < 9, "wheeze").otherwise("both").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


cte(
    "placed",
    """SELECT patient_id, row_number() OVER (ORDER BY md5('42|' || patient_id), patient_id) AS place, count(*) OVER () AS n FROM (
    SELECT DISTINCT 'P' || (vec_id % 37) AS patient_id FROM embeddings)""",
)


@fam.add("spk_sample_patients", stmt("SELECT 'P' || (vec_id % 37) AS patient_id, vec_id AS cycle_index FROM embeddings JOIN placed ON patient_id = 'P' || (vec_id % 37) WHERE place <= 12", "placed"))
def _sample(spark, sf):
    return SP.sample_patients(patient_cycles(spark, sf), 12, 42).select("patient_id", "cycle_index")


@fam.add(
    "spk_group_split",
    stmt("SELECT patient_id, vec_id AS cycle_index, CASE WHEN place <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS side FROM embeddings JOIN placed ON patient_id = 'P' || (vec_id % 37)", "placed"),
)
def _split(spark, sf):
    train, test = SP.group_split(patient_cycles(spark, sf), 0.3, 42)
    pick = lambda df, side: df.select("patient_id", "cycle_index", F.lit(side).alias("side"))
    return pick(train, "train").unionByName(pick(test, "test"))


@fam.add("spk_classify_cycles")
def _classify(spark, sf):
    train, test = SP.group_split(patient_cycles(spark, sf), 0.3, 42)
    model = SP.train_cycle_classifier(train, trees=200, seed=42)
    return SP.predict_cycles(model, test).select("patient_id", "cycle_index", "label", "predicted_label", F.round("confidence", 6).alias("confidence"))


@fam.add(
    "spk_classify_faults",
    stmt(
        """SELECT patient_id, count(*) AS cycles, 0::BIGINT AS unknown_label, 0::BIGINT AS bad_confidence, 0::BIGINT AS repeated
        FROM placed JOIN embeddings ON patient_id = 'P' || (vec_id % 37) WHERE place <= ceil(n * 0.3) GROUP BY 1""",
        "placed",
    ),
)
def _classify_faults(spark, sf):
    """Each held-out cycle is predicted once, by a label of the training part, with a
    confidence no lower than an even share."""
    train, test = SP.group_split(patient_cycles(spark, sf), 0.3, 42)
    out = SP.predict_cycles(SP.train_cycle_classifier(train, trees=50, seed=42), test)
    known = train.select(F.col("label").alias("predicted_label")).distinct().withColumn("known", F.lit(True))
    count = lambda c: F.sum(c.cast("long"))
    n_labels = train.select("label").distinct().count()
    judged = out.join(known, "predicted_label", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return judged.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("cycles"),
        count(~F.col("known")).alias("unknown_label"),
        count((F.col("confidence") > 1 + 1e-9) | (F.col("confidence") < 1 / n_labels - 1e-9)).alias("bad_confidence"),
        (F.count(F.lit(1)) - F.count_distinct("cycle_index")).alias("repeated"),
    )


def judged(cycles: DataFrame) -> DataFrame:
    return cycles.withColumn("predicted_label", F.col("label")).withColumn("confidence", (F.col("end_s") % 20) / dbl(20))


def cycles(spark, sf) -> DataFrame:
    return REC.parse_cycle_lines(SRC.cycle_lines(spark, sf))


cte(
    "predicted",
    """SELECT *, label AS predicted_label, (end_s % 20) / 20.0::DOUBLE AS confidence,
    row_number() OVER (PARTITION BY record_id ORDER BY cycle_index, start_s, end_s) AS position FROM cycles""",
    "cycles",
)


@fam.add(
    "spk_worst_cycle",
    stmt(
        """SELECT record_id, position, predicted_label, round(confidence, 6) AS confidence FROM predicted WHERE predicted_label <> 'normal'
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY confidence DESC, position) = 1""",
        "predicted",
    ),
)
def _worst(spark, sf):
    return SP.worst_cycle(judged(SP.cycle_positions(cycles(spark, sf)))).withColumn("confidence", F.round("confidence", 6))


@fam.add(
    "spk_anomalous_cycle_evidence",
    stmt("SELECT record_id, cycle_index, record_id || '-cycle' || cycle_index || '-' || predicted_label AS evidence_id FROM predicted WHERE predicted_label <> 'normal'", "predicted"),
)
def _cycle_evidence(spark, sf):
    return SP.anomalous_cycle_evidence(judged(cycles(spark, sf))).select("record_id", "cycle_index", "evidence_id")


@fam.add(
    "spk_consult_summary",
    stmt(
        """SELECT m.recording_id, m.reliable, CASE WHEN m.reliable THEN label END AS sentiment_label, CASE WHEN m.reliable THEN round(score, 6) ELSE 0.0 END AS sentiment_score,
        CASE WHEN m.reliable THEN coalesce(n, 0) ELSE 0 END AS critical_terms_found, round(fs, 5) AS fatigue_score, round(fs, 5) > 0.2 AS fatigued
        FROM mood m LEFT JOIN (SELECT recording_id, count(*) AS n FROM hits GROUP BY 1) h ON h.recording_id = m.recording_id
        LEFT JOIN (SELECT recording_id, (z1 + z2 - z3 + z4 - z5) / 5.0 AS fs FROM (SELECT recording_id,
            {1} AS z1, {2} AS z2, {3} AS z3, {4} AS z4, {5} AS z5 FROM consult_acoustic WINDOW r AS ())) f ON f.recording_id = m.recording_id""".replace("{1}", Z.format("jitter"))
        .replace("{2}", Z.format("shimmer"))
        .replace("{3}", Z.format("hnr"))
        .replace("{4}", Z.format("pause"))
        .replace("{5}", Z.format("rate")),
        "mood",
        "hits",
    ).replace(
        "WITH ",
        """WITH consult_acoustic AS (SELECT conv_id::VARCHAR AS recording_id, max(length(text)) / 1000.0::DOUBLE AS jitter, min(length(text)) / 1000.0::DOUBLE AS shimmer,
        max(turn)::DOUBLE AS hnr, (conv_id % 7)::DOUBLE AS pause, (conv_id % 5)::DOUBLE AS rate FROM conversations GROUP BY conv_id HAVING min(length(text)) >= 40), """,
        1,
    ),
)
def _consult(spark, sf):
    c = V.table(spark, sf, "conversations")
    acoustic = c.groupBy("conv_id").agg(
        (F.max(F.length("text")) / dbl(1000)).alias("jitter_local"),
        (F.min(F.length("text")) / dbl(1000)).alias("shimmer_local"),
        F.max("turn").cast("double").alias("hnr_db"),
    )
    # a recording with a turn too short to measure has no acoustic row
    acoustic = acoustic.filter("shimmer_local >= 0.04D").select(
        F.col("conv_id").cast("string").alias("recording_id"),
        F.lit("run").alias("run_id"),
        "jitter_local",
        "shimmer_local",
        "hnr_db",
        (F.col("conv_id") % 7).cast("double").alias("pause_rate"),
        (F.col("conv_id") % 5).cast("double").alias("speaking_rate_wps"),
    )
    out = SP.consult_summary(V.segments(spark, sf), acoustic, V.TERMS, V.POSITIVE, V.NEGATIVE, 0.2, NS)
    fatigue = F.round("fatigue_score", 5)
    return out.select(
        "recording_id",
        "reliable",
        "sentiment_label",
        F.round("sentiment_score", 6).alias("sentiment_score"),
        "critical_terms_found",
        fatigue.alias("fatigue_score"),
        (fatigue > dbl(0.2)).alias("fatigued"),
    )
