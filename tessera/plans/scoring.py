"""Queries of scoring, comparison and error analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.numbers import exact_round
from tessera.operators import evaluation, shared, word_edits
from tessera.plans import surrogates as s


def rounded(rows, *columns, places=6):
    return rows.withColumns({c: exact_round(F.col(c), places) for c in columns})


def evaluable_predictions(spark, d):
    return evaluation.evaluable(s.predictions(spark, d)).select("audio_path", "duration_sec")


def corpus_wer_by_lang(spark, d):
    rows = evaluation.evaluable(s.predictions(spark, d))
    return rounded(word_edits.corpus_rates(evaluation.sample_scores(rows, ["lang"]), "lang"), "wer", "cer")


def sample_scores(spark, d):
    metadata = s.table(spark, d, "labels").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("audio_path"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("speaker_id"), F.struct("quality", "toxic").alias("seq"))
    _, samples = evaluation.evaluation(s.predictions(spark, d), metadata, "m")
    return rounded(samples.select("audio_path", "wer", "cer", "substitutions", "deletions", "insertions", "reference_words", "speaker_id"), "wer", "cer")


def evaluation_metrics(spark, d):
    metrics, _ = evaluation.evaluation(s.predictions(spark, d), None, "m")
    return rounded(metrics, "wer", "cer")


def gold_scores(spark, d):
    return evaluation.gold_scores(s.predictions(spark, d), s.gold_eval(spark, d), "m", ["src0", "src1"])


def gold_metrics(spark, d):
    m = gold_scores(spark, d).metrics
    return rounded(m.select("model", "label", F.array_join("test_chapters", ";").alias("test_chapters"), "evaluated_samples", "evaluated_minutes", "wer", "cer", "substitutions", "deletions", "insertions", "reference_words", F.array_join("speakers", ";").alias("speakers")), "wer", "cer")


def gold_samples(spark, d):
    return rounded(gold_scores(spark, d).samples.select("segment_id", "speaker_id", "duration_sec", "wer", "cer", "reference_words"), "wer", "cer")


def all_edit_pairs(spark, d):
    rows = evaluation.evaluable(s.predictions(spark, d))
    plain = [text.strip_punctuation(F.col(c)) for c in ("reference", "prediction")]
    return word_edits.edit_pairs(word_edits.edits_in_order(rows, *plain, F.col("seq")))


def edit_pairs(spark, d):
    return evaluation.in_input_order(all_edit_pairs(spark, d))


def edit_pair_totals(spark, d):
    return all_edit_pairs(spark, d).groupBy("type").agg(F.sum("count").alias("n"))


def top_substitutions(spark, d):
    return word_edits.top_substitutions(all_edit_pairs(spark, d)).select("reference_word", "hypothesis_word", "count", "similarity", "heuristic_note")


def similar_substitutions(spark, d):
    return word_edits.substitution_totals(all_edit_pairs(spark, d))


def error_summaries(spark, d):
    rows = evaluation.sample_scores(evaluation.evaluable(s.predictions(spark, d)), ["audio_path", "reference", "prediction"])
    return evaluation.error_analysis(rows).select("audio_path", "error_summary", "manual_category", "notes")


def character_error_rates(spark, d):
    rows = s.pairs(spark, d)
    rate = text.error_rate(text.strip_punctuation(F.col("reference")), text.strip_punctuation(F.col("hypothesis")))
    return rows.select("doc_id", exact_round(rate, 6).alias("cer"))


def two_runs(spark, d):
    """Metrics and samples of two runs over the same segments: the hypotheses, and the references without their last word.

    Both are scored once, in one pass; the scores are written, as metrics, test sets and counts all read them.
    """
    shorter = F.regexp_replace("reference", " [^ ]*$", "")
    sides = F.inline(F.array(*[F.struct(F.lit(side).alias("side"), own.alias("prediction")) for side, own in (("one", F.col("hypothesis")), ("two", shorter))]))
    rows = s.pairs(spark, d).filter("reference <> ''").select(F.format_string("s%08d", "doc_id").alias("segment_id"), "reference", "n_chars", sides)
    both = shared.kept(evaluation.sample_scores(rows, ["side", "segment_id", "n_chars"]), "two-runs")
    out = []
    for side, label in (("one", "PILOT EVALUATION"), ("two", "FINAL EVALUATION")):
        samples = both.filter(F.col("side") == side).drop("side")
        metrics = word_edits.corpus_rates(samples, more={"evaluated_minutes": F.sum("n_chars") / 540}).withColumn("label", F.lit(label))
        out.append((metrics, samples))
    return out


def run_comparison(spark, d):
    a, b = two_runs(spark, d)
    differences, label = evaluation.comparison(a, b)
    return rounded(differences.withColumn("label", F.lit(label)), "a", "b")


def order_key_differences(spark, d):
    a = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return evaluation.set_difference(a, s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


def metric_comparison(spark, d):
    """Metrics of two groups of turns side by side."""
    rows = s.table(spark, d, "conversations").groupBy("role").agg(F.count("*").cast("double").alias("turns"), F.avg(F.char_length("text")).alias("mean_chars"))
    a, b = (rows.filter(F.col("role") == r) for r in ("user", "assistant"))
    return rounded(evaluation.compared(a, b, ("turns", "mean_chars")), "a", "b")


QUERIES = {f.__name__: f for f in (evaluable_predictions, corpus_wer_by_lang, sample_scores, evaluation_metrics, gold_metrics, gold_samples, edit_pairs, edit_pair_totals, top_substitutions, similar_substitutions, error_summaries, character_error_rates, run_comparison, order_key_differences, metric_comparison)}

R, H = (f"list_filter(string_split({x}, ' '), lambda w: w <> '')" for x in ("r", "h"))


def scored_sql(source: str, name: str = "scored") -> str:
    """name: rows of source(reference, prediction) with the counts that rates are made of."""
    plain = f"{name}_plain as (select *, {s.stripped_sql('reference')} as r, {s.stripped_sql('prediction')} as h from {source})"
    lists = f"{name}_lists as (select *, {R} as rw, {H} as hw, levenshtein({s.letters_sql('r')}, {s.letters_sql('h')})::bigint as char_edits, length(r)::bigint as chars from {name}_plain)"
    folded = f"{name}_folded as (select *, {s.counts_sql('rw', 'hw')} as f from {name}_lists)"
    dels = "f.d::bigint"
    ins = f"({dels} + len(hw) - len(rw))::bigint"
    return f"{plain}, {lists}, {folded}, {name} as (select *, (f.c - {dels} - {ins})::bigint as substitutions, {dels} as deletions, {ins} as insertions, len(rw)::bigint as reference_words, f.c::bigint as word_edits from {name}_folded)"


OK = f"ok as (select * from predictions where regexp_matches(reference, '[^{s.WS[1:]}') and status = 'ok')"


def six(x: str) -> str:
    """To six places, by the exact binary value."""
    return f"cast(format('{{:.6f}}', {x}) as double)"


RATES = f"{six('sum(word_edits) / sum(reference_words)')} as wer, {six('sum(char_edits) / sum(chars)')} as cer, sum(substitutions)::bigint as substitutions, sum(deletions)::bigint as deletions, sum(insertions)::bigint as insertions, sum(reference_words)::bigint as reference_words"
ROW = f"{six('word_edits / nullif(reference_words, 0)')} as wer, {six('char_edits / nullif(chars, 0)')} as cer"
GOLD_EVAL = """gold_eval as (select 'd/' || doc_id as audio_path, reference as gold_reference, source as speaker_id, printf('s%08d', doc_id) as segment_id, n_chars / 9.0::double as gold_duration from pairs where doc_id in (select doc_id from labels)),
 told as (select p.audio_path, g.gold_reference as reference, p.prediction, g.speaker_id, g.segment_id, g.gold_duration as duration_sec from predictions p join gold_eval g on p.audio_path = g.audio_path where p.status = 'ok')"""
SCORED = f"with {s.PREDICTIONS}, {OK}, {scored_sql('ok')}"
LABELLED = "labelled as (select 'd/' || doc_id as audio_path, arg_max('q' || quality, (quality, toxic)) as speaker_id from labels group by 1)"
RUNS = f"""with {s.PAIRS}, one as (select doc_id, n_chars, reference, hypothesis as prediction from pairs where reference <> ''), two as (select doc_id, n_chars, reference, regexp_replace(reference, ' [^ ]*$', '') as prediction from pairs where reference <> ''),
 {scored_sql('one', 'scored_one')}, {scored_sql('two', 'scored_two')}"""


def long_sql(name: str) -> str:
    cols = {"wer": "sum(word_edits) / sum(reference_words)", "cer": "sum(char_edits) / sum(chars)", "substitutions": "sum(substitutions)", "deletions": "sum(deletions)", "insertions": "sum(insertions)", "reference_words": "sum(reference_words)", "evaluated_samples": "count(*)", "evaluated_minutes": "sum(n_chars) / 540"}
    return " union all ".join(f"select '{k}' as metric, ({v})::double as v from {name}" for k, v in cols.items())


ORACLE_SQL = {
    "evaluable_predictions": f"with {s.PREDICTIONS}, {OK} select audio_path, duration_sec from ok",
    "corpus_wer_by_lang": f"{SCORED} select lang, count(*) as evaluated_samples, {RATES} from scored group by lang",
    "sample_scores": f"{SCORED}, {LABELLED} select s.audio_path, {ROW}, substitutions, deletions, insertions, reference_words, coalesce(l.speaker_id, '') as speaker_id from scored s left join labelled l on s.audio_path = l.audio_path",
    "evaluation_metrics": f"{SCORED} select 'm' as model, count(*) as dataset_size, count(*) as evaluated_samples, {RATES}, (select count(*) from predictions) as total_predictions from scored",
    "gold_metrics": f"with {s.PREDICTIONS}, {GOLD_EVAL}, {scored_sql('told')} select 'm' as model, 'PILOT EVALUATION' as label, 'src0;src1' as test_chapters, count(*) as evaluated_samples, cast(format('{{:.2f}}', sum(duration_sec) / 60) as double) as evaluated_minutes, {RATES}, string_agg(distinct speaker_id, ';' order by speaker_id) as speakers from scored",
    "gold_samples": f"with {s.PREDICTIONS}, {GOLD_EVAL}, {scored_sql('told')} select segment_id, speaker_id, duration_sec, {ROW}, reference_words from scored",
    "edit_pair_totals": f"{SCORED} select type, n from (select unnest([{{'type': 'substitution', 'n': sum(substitutions)::bigint}}, {{'type': 'deletion', 'n': sum(deletions)::bigint}}, {{'type': 'insertion', 'n': sum(insertions)::bigint}}], recursive := true) from scored)",
    "error_summaries": f"""with {s.PREDICTIONS}, {OK}, {scored_sql('ok')}, raw as (select audio_path, word_edits / nullif(reference_words, 0) as wer, {s.words_sql('reference')} as rw2, {s.words_sql('prediction')} as hw2 from scored), folded as (select *, {s.counts_sql('rw2', 'hw2')} as g from raw)
 select audio_path, printf('substitutions=%d deletions=%d insertions=%d hits=%d', (g.c - 2 * g.d - len(hw2) + len(rw2))::bigint, g.d::bigint, (g.d + len(hw2) - len(rw2))::bigint, (len(rw2) - g.d - (g.c - 2 * g.d - len(hw2) + len(rw2)))::bigint) || case when wer >= 0.5 then ' [HIGH_WER]' else '' end as error_summary, '' as manual_category, '' as notes from folded""",
    "character_error_rates": f"with {s.PAIRS}, p as (select doc_id, {s.stripped_sql('reference')} as r, {s.stripped_sql('hypothesis')} as h from pairs) select doc_id, {six(f'levenshtein({s.letters_sql("r")}, {s.letters_sql("h")}) / nullif(length(r), 0)')} as cer from p",
    "run_comparison": f"{RUNS}, la as ({long_sql('scored_one')}), lb as ({long_sql('scored_two')}) select la.metric, {six('la.v')} as a, {six('lb.v')} as b, {six('lb.v - la.v')} as difference_b_minus_a, 'PILOT' as label from la join lb on la.metric = lb.metric",
    "order_key_differences": "select cast(count(*) filter (where j is null) as bigint) as only_a, cast(count(*) filter (where k is null) as bigint) as only_b from (select distinct o_orderkey as k from orders) full outer join (select distinct l_orderkey as j from lineitem) on k = j",
    "metric_comparison": f"with r as (select role, count(*)::double as turns, avg(length(text)) as mean_chars from conversations group by 1), l as (select role, 'turns' as metric, turns as value from r union all select role, 'mean_chars', mean_chars from r) select a.metric, {six('a.value')} as a, {six('b.value')} as b, {six('b.value - a.value')} as difference_b_minus_a from l a join l b on a.metric = b.metric where a.role = 'user' and b.role = 'assistant'",
}
