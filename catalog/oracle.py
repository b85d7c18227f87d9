"""SQL for DuckDB, one text per registered query that SQL can express over whole tables."""

from __future__ import annotations

from catalog.fixtures import (
    DIRTY_LABEL,
    FIXTURE_MIN, FIXTURE_MINIMA, FIXTURE_RATIO, FIXTURE_RATIOS, FIXTURE_STOP_WORDS, FIXTURE_SWEEP,
    PAPERS_SQL,
)
from papersieve.operators.disciplines import GRID_MINIMA, GRID_RATIOS, SWEEP
from papersieve.operators.metrics import SEARCH_THRESHOLDS
from papersieve.operators.screening import SENSITIVITY_THRESHOLDS
from papersieve.sources.anchors import DISCIPLINES

ORACLES: dict[str, str] = {}


def doubles(values) -> str:
    """Exact doubles: text casts, since a bare literal would pass through DECIMAL."""
    return "[" + ", ".join(f"'{v!r}'::double" for v in values) + "]"


PAPERS = PAPERS_SQL.format(documents="documents")
BOUND_L, BOUND_R = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"

CLEAN = f"""
papers as ({PAPERS}),
base as (
  select *, doc_type as original_doc_type, source_title as original_source_title,
    try_cast(pub_year as double) as year,
    case when regexp_matches(doc_type, 'Retracted Publication|Retraction|News|Book Review|Editorial|Interview|Correction|Meeting Abstract', 'i') then 'Invalid document type'
      when try_cast(pub_year as double) is null then 'Missing publication year'
      when try_cast(pub_year as double) < 2016 or try_cast(pub_year as double) > 2025 then 'Publication year outside 2016-2025'
      when doc_type is null or not (lower(doc_type) like '%review%' or lower(doc_type) like '%article%') then 'Unsupported document type'
      when title is null or abstract is null then 'Missing title or abstract' end as reason
  from papers),
norm as (
  select * replace (
    case upper(trim(source_title)) when 'SCIENCE (NEW YORK, N.Y.)' then 'SCIENCE' else upper(trim(source_title)) end as source_title,
    case when reason in ('Invalid document type', 'Missing publication year', 'Publication year outside 2016-2025') then doc_type
      when lower(doc_type) like '%review%' then 'review' when lower(doc_type) like '%article%' then 'article' else lower(doc_type) end as doc_type,
    cast(year as integer) as pub_year)
  from base),
ut_rank as (select *, row_number() over (partition by ut order by paper_id) as ut_rn from norm where reason is null),
title_rank as (select paper_id, row_number() over (partition by lower(trim(title)), year order by paper_id) as title_rn
  from ut_rank where ut_rn = 1),
annotated as (
  select n.* exclude (reason), case when n.reason is not null then n.reason
      when u.ut_rn > 1 then 'Duplicate identical UT'
      when t.title_rn > 1 then 'Duplicate normalized title and year'
      when n.source_title not in ('NATURE', 'SCIENCE', 'CELL') then 'Non-CNS source' end as removal_reason
  from norm n left join ut_rank u using (paper_id) left join title_rank t using (paper_id))
"""

ORACLES["cleaning_waterfall"] = f"""
with {CLEAN}, items(step, item) as (values (0, 'Initial records'), (1, 'Invalid document type'),
  (2, 'Missing publication year'), (3, 'Publication year outside 2016-2025'), (4, 'Unsupported document type'),
  (5, 'Missing title or abstract'), (6, 'Duplicate identical UT'), (7, 'Duplicate normalized title and year'),
  (8, 'Non-CNS source'), (9, 'Total removed'), (10, 'Final records'))
select step, item, case step when 0 then (select count(*) from annotated)
  when 9 then (select count(removal_reason) from annotated)
  when 10 then (select count(*) from annotated where removal_reason is null)
  else (select count(*) from annotated where removal_reason = item) end as paper_count
from items
"""

ORACLES["clean_corpus"] = f"""
with {CLEAN} select paper_id, ut, title, doc_type, source_title, pub_year, md5(abstract) as abstract_md5
from annotated where removal_reason is null
"""

ORACLES["removed_records"] = f"""
with {CLEAN} select paper_id, ut, coalesce(doc_type, '') as doc_type, original_source_title, source_title, removal_reason
from annotated where removal_reason is not null
"""

ORACLES["text_build"] = f"""
with papers as ({PAPERS}), t as (
  select paper_id, concat(coalesce(title, ''), '[SEP]', coalesce(abstract, '')) as text from papers
  where trim(coalesce(title, '')) <> '' or trim(coalesce(abstract, '')) <> '')
select paper_id, cast(length(text) as integer) as n_chars, md5(text) as text_md5 from t
"""

ORACLES["label_clean"] = f"""
with dirty as (select doc_id, {DIRTY_LABEL} as label from labels)
select doc_id, cast(try_cast(trim(label) as double) as integer) as label from dirty
where try_cast(trim(label) as double) in (0, 1)
"""

ORACLES["doc_type_counts"] = f"""
with papers as ({PAPERS}), t as (
  select case when lower(doc_type) like '%review%' then 'review' when lower(doc_type) like '%article%' then 'article'
    else lower(doc_type) end as doc_type from papers where doc_type is not null)
select doc_type, count(*) as count, round(count(*) / sum(count(*)) over (), 6) as share from t group by doc_type
"""


def keyword_case(text: str, tiers: list[tuple[str, str]]) -> str:
    whens = " ".join(
        f"when regexp_matches({text}, '{BOUND_L}({words}){BOUND_R}', 'i') then {score}::double"
        for score, words in tiers
    )
    return f"case {whens} else 0.0::double end"


DEFAULT_KEYWORDS = [
    ("0.9", "large language models?|llms?|transformers?"),
    ("0.75", "deep learning|neural networks?|machine learning|natural language processing|nlp"
             "|computer vision|reinforcement learning|ai"),
]
FIXTURE_KEYWORDS = [("0.9", "thing|thou"), ("0.75", "ai|nlp")]

ORACLES["keyword_scores"] = f"""
select doc_id, {keyword_case('text', DEFAULT_KEYWORDS)} as keyword_score,
  {keyword_case('text', FIXTURE_KEYWORDS)} as fixture_score from documents
"""

UNIT = "cast(concat('0x', substr(md5(concat(cast({id} as string), ':score')), 1, 8)) as bigint) / 4294967295.0::double"
LABELLED = f"""labelled as (select doc_id as paper_id, quality as label,
  0.6::double * ({UNIT.format(id='doc_id')}) + 0.3::double * quality as score from labels)"""
SCORED = f"""
{CLEAN}, built as (
  select *, concat(title, '[SEP]', abstract) as text, {UNIT.format(id='paper_id')} as model_score
  from annotated where removal_reason is null),
scored as (
  select *, {keyword_case('text', FIXTURE_KEYWORDS)} as keyword_score,
    greatest(model_score, {keyword_case('text', FIXTURE_KEYWORDS)}) as final_score
  from built where trim(title) <> '' or trim(abstract) <> '')
"""
SOURCE = """case when keyword_score > model_score then 'keyword_only'
  when model_score > keyword_score then 'model_only' else 'both' end"""


def curve(thresholds) -> str:
    return f"""
curve as (select threshold,
    count(*) filter (where label = 1 and score >= threshold) as tp,
    count(*) filter (where label = 0 and score >= threshold) as fp,
    count(*) filter (where label = 1 and score < threshold) as fn
  from labelled, (select unnest({doubles(thresholds)}) as threshold) group by threshold),
f1s as (select *, case when tp = 0 then 0.0 else 2.0 * tp / (2.0 * tp + fp + fn) end::double as f1 from curve),
best as (select coalesce(first(threshold order by f1 desc, threshold) filter (where f1 > 0), 0.5::double) as best_threshold,
    coalesce(max(f1), 0) as best_f1 from f1s)"""


SEARCH = f"{LABELLED}, {curve(SEARCH_THRESHOLDS)}"

ORACLES["hybrid_screen"] = f"""
with {SEARCH}, {SCORED}
select paper_id, round(model_score, 6) as model_score, round(keyword_score, 6) as keyword_score,
  round(final_score, 6) as final_score, 1 as predicted_is_computer, {SOURCE} as prediction_source
from scored where final_score >= (select greatest(0.35::double, best_threshold) from best)
"""

ORACLES["prediction_source_dist"] = f"""
with {SCORED}, chosen as (select {SOURCE} as source from scored where final_score >= 0.5::double)
select source, count(*) as count, round_even(count(*) * 100.0 / sum(count(*)) over (), 2)::double as percentage
from chosen group by source
"""

ORACLES["corpus_sensitivity"] = f"""
with {SCORED} select threshold, count(*) filter (where final_score >= threshold) as ai_count,
  round(count(*) filter (where final_score >= threshold) / (select count(*) from documents), 6) as proportion
from scored, (select unnest({doubles(SENSITIVITY_THRESHOLDS)}) as threshold) group by threshold
"""

ORACLES["corpus_stats"] = f"""
with {SCORED} select (select count(*) from documents) as original_count, count(*) as after_cleaning_count,
  count(*) filter (where final_score >= 0.5::double) as final_count,
  round(count(*) filter (where final_score >= 0.5::double) * 100.0::double / (select count(*) from documents), 6) as final_percentage
from scored
"""

ORACLES["stratified_split_labels"] = f"""
with {LABELLED}, ranked as (
  select paper_id, label, row_number() over (partition by label order by md5(concat(paper_id, ':42')), paper_id) as rn,
    count(*) over (partition by label) as n from labelled)
select paper_id, label, rn <= round(n * 0.2::double) as is_validation from ranked
"""

ORACLES["class_weight"] = f"""
with {LABELLED} select count(*) filter (where label = 0) as n_neg, count(*) filter (where label = 1) as n_pos,
  round(count(*) filter (where label = 0) / greatest(count(*) filter (where label = 1), 1), 6) as scale_pos_weight
from labelled
"""

ORACLES["best_threshold"] = f"""
with {SEARCH} select round(best_threshold, 6) as best_threshold, round(best_f1, 6) as best_f1 from best
"""

CONFUSION = f"""{LABELLED}, confusion as (select count(*) filter (where label = 0 and score < 0.5) as tn,
  count(*) filter (where label = 0 and score >= 0.5) as fp, count(*) filter (where label = 1 and score < 0.5) as fn,
  count(*) filter (where label = 1 and score >= 0.5) as tp from labelled)"""

ORACLES["confusion_matrix"] = f"with {CONFUSION} select tn, fp, fn, tp from confusion"

ORACLES["class_report"] = f"""
with {CONFUSION}, per_class as (
  select '0' as class, tn / (tn + fn) as precision, tn / (tn + fp) as recall, 2.0::double * tn / (2 * tn + fn + fp) as f1, tn + fp as support from confusion
  union all
  select '1', tp / (tp + fp), tp / (tp + fn), 2.0::double * tp / (2 * tp + fp + fn), tp + fn from confusion),
lines as (
  select * from per_class
  union all select 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp from confusion
  union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::bigint from per_class
  union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::bigint from per_class)
select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from lines
"""

AUC = """auc as (select sum(wins) / (sum(pos)::double * sum(neg)) as auc from (
  select pos, neg, pos * (coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) + 0.5::double * neg) as wins
  from (select score, count(*) filter (where label = 1) as pos, count(*) filter (where label = 0) as neg from labelled group by score)))"""

ORACLES["roc_auc"] = f"with {LABELLED}, {AUC} select round(auc, 6) as auc from auc"

ORACLES["validation_sensitivity"] = f"""
with {LABELLED}, {curve(SENSITIVITY_THRESHOLDS)}
select threshold, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision,
  round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(f1, 6) as f1 from f1s
"""

ORACLES["validation_summary"] = f"""
with {SEARCH}, {AUC}
select 'AUC' as metric, round(auc, 6) as value from auc
union all select 'F1', round(best_f1, 6) from best
union all select 'Best Threshold', round(best_threshold, 6) from best
union all select 'Validation Size', count(*)::double from labelled
"""


# ---- disciplines ------------------------------------------------------------------------------

SIMS = """
cells as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from embeddings),
centroid as (select label, dim, avg(x) as x from cells group by label, dim),
anchor as (select label, list(x order by dim) as v from centroid group by label),
sims as (select vec_id as paper_id, a.label as ordinal, concat('label_', a.label) as discipline,
    list_cosine_similarity(embedding::double[], v) as sim from embeddings, anchor a),
ranked as (select *, row_number() over (partition by paper_id order by sim desc, ordinal) as rn from sims),
top as (select paper_id, max(sim) filter (where rn = 1) as s1, max(sim) filter (where rn = 2) as s2,
    max(sim) filter (where rn = 3) as s3, max(discipline) filter (where rn = 1) as d1,
    max(discipline) filter (where rn = 2) as d2, max(discipline) filter (where rn = 3) as d3 from ranked group by paper_id)
"""


def breadth_case(ratio: str, minimum: str) -> str:
    two = f"s2 >= {ratio} * s1 and s2 >= {minimum}"
    return f"case when {two} and s3 >= {ratio} * s2 and s3 >= {minimum} then 3 when {two} then 2 else 1 end"


PICK = breadth_case(f"{FIXTURE_RATIO}::double", f"{FIXTURE_MIN}::double")
ASSIGNED = f"""{SIMS}, assigned as (select *, {PICK} as presence_breadth from top),
exploded as (select paper_id, presence_breadth, unnest([d1, d2, d3][1:presence_breadth]) as discipline from assigned),
papers as ({PAPERS}),
years as (select paper_id, try_cast(pub_year as integer) as pub_year from papers)"""

ORACLES["anchor_scores"] = f"with {SIMS} select paper_id, ordinal, discipline, round(sim, 6) as sim from sims"

ORACLES["discipline_assign"] = f"""
with {ASSIGNED} select paper_id, presence_breadth,
  array_to_string([d1, d2, d3][1:presence_breadth], '|') as present_disciplines from assigned
"""

ORACLES["breadth_stats"] = f"""
with {ASSIGNED} select b as presence_breadth, count(*) filter (where presence_breadth = b) as paper_count,
  round(count(*) filter (where presence_breadth = b) * 100.0::double / count(*), 6) as percentage
from assigned, (values (1), (2), (3)) v(b) group by b
"""

ORACLES["discipline_counts"] = f"""
with {ASSIGNED} select discipline, count(*) as paper_count from exploded group by discipline
"""


def grid_sql(ratios, minima, rounded: bool) -> str:
    names = "round(ratio, 6) as ratio, round(min, 6) as min" if rounded else "ratio, min"
    return f"""
with {SIMS}, grid as (select ratio, min from (select unnest({doubles(ratios)}) as ratio), (select unnest({doubles(minima)}) as min)),
picked as (select ratio, min, paper_id, s1, s2, s3, d1, d2, d3, {breadth_case('ratio', 'min')} as b from top, grid),
rates as (select ratio, min, avg((b >= 2)::int) as multi_rate, avg((b = 1)::int) as single_rate, avg(s1) as top1_sim,
    avg(case b when 1 then s1 when 2 then (s1 + s2) / 2 else (s1 + s2 + s3) / 3 end) as selected_sim
  from picked group by ratio, min),
shares as (select ratio, min, count(*) / sum(count(*)) over (partition by ratio, min) as p
  from (select ratio, min, unnest([d1, d2, d3][1:b]) as discipline from picked) group by ratio, min, discipline),
entropies as (select ratio, min, -sum(p * ln(p + 1e-10)) as entropy from shares group by ratio, min)
select {names}, round(multi_rate, 6) as multi_rate, round(single_rate, 6) as single_rate, round(top1_sim, 6) as top1_sim,
  round(selected_sim, 6) as selected_sim, round(entropy, 6) as entropy from rates join entropies using (ratio, min)
"""


ORACLES["threshold_grid"] = grid_sql(FIXTURE_RATIOS, FIXTURE_MINIMA, rounded=False)
ORACLES["threshold_grid_default"] = grid_sql(GRID_RATIOS, GRID_MINIMA, rounded=True)
ORACLES["current_setting"] = f"""
select * from ({grid_sql(GRID_RATIOS, GRID_MINIMA, rounded=True)}) where ratio = 0.95 and min = 0.8
"""

ORACLES["discipline_entropy"] = f"""
with {ASSIGNED}, shares as (select count(*) / sum(count(*)) over () as p from exploded group by discipline)
select round(-sum(p * ln(p + 1e-10)), 6) as entropy from shares
"""

def sweep_sql(values, shown: str) -> str:
    return f"""
with {SIMS}, picked as (select t, {breadth_case('t', 't')} as b from top, (select unnest({doubles(values)}) as t))
select {shown} as threshold, v.b as presence_breadth, round(count(*) filter (where picked.b = v.b) / count(*), 6) as share
from picked, (values (1), (2), (3)) v(b) group by t, v.b
"""


ORACLES["breadth_sweep"] = sweep_sql(FIXTURE_SWEEP, "t")
ORACLES["breadth_sweep_default"] = sweep_sql(SWEEP, "round(t, 6)")

YEARLY = f"""{ASSIGNED}, yearly as (select pub_year, discipline, count(*) as paper_count from exploded join years using (paper_id)
  where pub_year is not null group by pub_year, discipline)"""

ORACLES["discipline_trends"] = f"with {YEARLY} select pub_year, discipline, paper_count from yearly"

ORACLES["discipline_share"] = f"""
with {YEARLY} select pub_year, discipline, paper_count, cast(sum(paper_count) over (partition by pub_year) as bigint) as total,
  round(paper_count / sum(paper_count) over (partition by pub_year) * 100, 6) as percentage from yearly
"""

ORACLES["research_type_trends"] = f"""
with {ASSIGNED}, grouped as (select pub_year, presence_breadth, count(*) as paper_count from assigned join years using (paper_id)
  where pub_year is not null group by pub_year, presence_breadth)
select pub_year, case when presence_breadth = 1 then 'Single-disciplinary' else 'Interdisciplinary' end as research_type,
  paper_count, cast(sum(paper_count) over (partition by pub_year) as bigint) as total_papers,
  round(paper_count / sum(paper_count) over (partition by pub_year) * 100, 6) as percentage from grouped
"""

LITERAL = "concat('[''', array_to_string([d1, d2, d3][1:presence_breadth], ''', '''), ''']')"

ORACLES["select_include"] = f"""
with {ASSIGNED} select paper_id, {LITERAL} as present_disciplines from assigned
where list_contains([d1, d2, d3][1:presence_breadth], 'label_3')
"""

ORACLES["select_only"] = f"""
with {ASSIGNED} select paper_id, {LITERAL} as present_disciplines from assigned
where presence_breadth = 1 and d1 = 'label_3'
"""

ORACLES["discipline_corpus"] = f"""
with {ASSIGNED}, docs as (select doc_id as paper_id, length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as n
  from documents where doc_id in (select paper_id from exploded where discipline = 'label_3'))
select paper_id, cast(n as integer) as n_chars from docs where n > 50 and (select count(*) from docs where n > 50) >= 20
"""

# ---- text -------------------------------------------------------------------------------------

LAYOUT = f"{BOUND_L}(fig|table|eq|section){BOUND_R}"
BLANKED = [
    (r"\S+@\S+", " "), (r"http\S+|doi:\S+", " "), (r"\[\d+\]", " "),
    (LAYOUT, r"\1 \3"), (LAYOUT, r"\1 \3"),  # twice: neighbouring hits share the separator between them
    (r"[^a-z0-9_\s]", " "),
    (r"\b(edu|cn|com|org|stanford|harvard|mit|turing|microsoft|google|deepmind|ibm)\b", " "),
    (r"\s+", " "),
]


def cleaned(text: str) -> str:
    text = f"lower(coalesce({text}, ''))"
    for pattern, replacement in BLANKED:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return f"trim({text})"


ORACLES["academic_clean"] = f"""
with c as (select doc_id, {cleaned('text')} as cleaned from documents)
select doc_id, cast(length(cleaned) as integer) as n_chars, md5(cleaned) as cleaned_md5 from c where length(cleaned) >= 50
"""

ORACLES["alpha_tokens"] = """
with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as tokens from documents)
select doc_id, cast(len(tokens) as integer) as n_tokens, md5(array_to_string(tokens, ' ')) as tokens_md5 from t
"""


# ---- topics -----------------------------------------------------------------------------------

STOP_LIST = ", ".join(f"'{w}'" for w in FIXTURE_STOP_WORDS)
TOPIC_DOCS = """topic_docs as (select doc_id as paper_id, text, embedding, case label when 9 then -1 else label end as topic
  from documents join embeddings on doc_id = vec_id)"""
WORDS_OF_DOC = f"""{TOPIC_DOCS},
doc_words as (select paper_id, topic, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: w not in ({STOP_LIST})) as w from topic_docs)"""


def counts_sql(name: str, docs: str, max_df: str) -> str:
    """Uni-gram counts with a document-frequency bound and the 10,000 most frequent terms."""
    return f"""{name}_raw as (select topic, term, count(*) as n from (select topic, unnest(w) as term from {docs}) group by topic, term),
{name}_df as (select *, count(*) over (partition by term) as df from {name}_raw),
{name}_in as (select * from {name}_df where df <= (select count(distinct topic) from {docs}) * {max_df}::double),
{name}_top as (select term from (select term, sum(n) as total from {name}_in group by term) order by total desc, term limit 10000),
{name} as (select topic, term, n from {name}_in where term in (select term from {name}_top))"""


def weights_sql(name: str, counts: str, damped: bool = False) -> str:
    share = "n / topic_total"
    return f"""{name}_t as (select *, sum(n) over (partition by topic) as topic_total, sum(n) over (partition by term) as f from {counts}),
{name} as (select topic, term, n, ln((select floor(sum(n) / count(distinct topic)) from {counts}) / f + 1) as idf,
    {f'sqrt({share})' if damped else share} * ln((select floor(sum(n) / count(distinct topic)) from {counts}) / f + 1) as weight
  from {name}_t)"""


def words_sql(name: str, weights: str) -> str:
    return f"""{name} as (select topic, cast(row_number() over (partition by topic order by weight desc, term) as integer) as rank, term, weight
  from {weights} qualify rank <= 15)"""


COUNTS = f"{WORDS_OF_DOC}, {counts_sql('counts', 'doc_words', '0.95')}"
WEIGHTS = f"{COUNTS}, {weights_sql('weights', 'counts')}"
TOP_WORDS = f"{WEIGHTS}, {words_sql('words', 'weights')}"
NGRAMS = f"""{WORDS_OF_DOC}, grams as (
  select topic, unnest(w) as term from doc_words
  union all select topic, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from doc_words
  union all select topic, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from doc_words),
gram_df as (select *, count(*) over (partition by term) as df from (select topic, term, count(*) as n from grams group by topic, term)),
gram_counts as (select topic, term, n from gram_df
  where df >= 2 and df <= (select count(distinct topic) from doc_words) * 0.9::double)"""

ORACLES["term_counts"] = f"with {COUNTS} select topic, term, n from counts"
ORACLES["term_counts_ngrams"] = f"with {NGRAMS} select topic, term, n from gram_counts"
ORACLES["ctfidf"] = f"""
with {WEIGHTS} select topic, term, n, round(idf, 6) as idf, round(weight, 6) as weight from weights
"""
ORACLES["ctfidf_damped"] = f"""
with {NGRAMS}, {weights_sql('weights', 'gram_counts', damped=True)} select topic, term, round(weight, 6) as weight from weights
"""
ORACLES["topic_words"] = f"with {TOP_WORDS} select topic, rank, term, round(weight, 6) as weight from words"
ORACLES["topic_info"] = f"""
with {TOP_WORDS}, listed as (select topic, string_agg(term, ' ' order by rank) as words from words where rank <= 10 group by topic),
sizes as (select topic, count(*) as size from topic_docs group by topic)
select topic, size, coalesce(words, '') as words from sizes left join listed using (topic)
"""
ORACLES["topic_count"] = f"with {TOPIC_DOCS} select count(distinct topic) as n_topics from topic_docs where topic <> -1"
ORACLES["representative_docs"] = f"""
with {WORDS_OF_DOC}, all_counts as (select topic, term, count(*) as n from (select topic, unnest(w) as term from doc_words) group by topic, term),
{weights_sql('weights', 'all_counts')},
tf as (select paper_id, topic, term, count(*) as tf from (select paper_id, topic, unnest(w) as term from doc_words where topic <> -1)
  group by paper_id, topic, term),
close as (select paper_id, topic, sum(tf * idf * weight) / sqrt(sum(tf * idf * tf * idf)) as c from tf join weights using (topic, term)
  group by paper_id, topic),
lengths as (select topic, sqrt(sum(weight * weight)) as len from weights group by topic)
select topic, cast(row_number() over (partition by topic order by round(c, 12) desc, paper_id) as integer) as rank, paper_id,
  round(c / len, 6) as similarity from close join lengths using (topic) qualify rank <= 3
"""

OVERLAP = f"""{TOP_WORDS}, sets as (select topic, list(term) as s from words where rank <= 10 group by topic),
overlap as (select a.topic as topic_i, b.topic as topic_j,
    len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) as value from sets a, sets b)"""
SIMILARITY = """cells as (select topic, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from topic_docs),
means as (select topic, list(x order by dim) as v from (select topic, dim, avg(x) as x from cells group by topic, dim) group by topic),
similarity as (select a.topic as topic_i, b.topic as topic_j, list_cosine_similarity(a.v, b.v) as value from means a, means b)"""

ORACLES["topic_overlap"] = f"with {OVERLAP} select topic_i, topic_j, round(value, 6) as value from overlap where value > 0"
ORACLES["topic_overlap_matrix"] = f"""
with {OVERLAP} select topic_i as topic, {", ".join(
    f"round(max(value) filter (where topic_j = {t}), 6) as t{str(t).replace('-', '_')}" for t in range(-1, 9)
)} from overlap group by topic_i
"""
ORACLES["topic_similarity"] = f"""
with {TOPIC_DOCS}, {SIMILARITY} select topic_i, topic_j, round(value, 6) as value from similarity
"""
ORACLES["max_pairs"] = f"""
with {OVERLAP}, {SIMILARITY},
both_ as (select 'word_overlap' as matrix, * from overlap where value > 0 union all select 'semantic_similarity', * from similarity)
select matrix, topic_i, topic_j, round(value, 6) as value from both_ where topic_i <> topic_j
qualify row_number() over (partition by matrix order by round(value, 12) desc, topic_i, topic_j) = 1
"""
ORACLES["topic_diversity"] = f"""
with {OVERLAP} select round(1 - avg(value), 6) as diversity from overlap where topic_i < topic_j and topic_i <> -1
"""

SPACE_TOKENS = f"""{TOPIC_DOCS}, token_docs as (select paper_id, tokens from (
    select doc_id as paper_id, regexp_extract_all({cleaned('text')}, '\\S+') as tokens from documents) where len(tokens) > 10)"""
LETTER_TOKENS = "token_docs as (select doc_id as paper_id, regexp_extract_all(lower(text), '[a-z]+') as tokens from documents)"
DICTIONARY = """dictionary as (select term, count(*) as df from (select distinct paper_id, unnest(tokens) as term from token_docs)
  group by term having count(*) >= 5 and count(*) <= (select count(*) from token_docs) * 0.5::double)"""

ORACLES["dictionary_filter"] = f"with {SPACE_TOKENS}, {DICTIONARY} select term, df from dictionary"


def npmi_sql(name: str, window: int, top_n: int, extra: str = "") -> str:
    """Every window of every document, spelled out."""
    return f"""{name}_words as (select topic, rank, term from words where rank <= {top_n} and topic <> -1 {extra}),
{name}_occ as (select paper_id, topic, rank, pos, n from (
    select paper_id, len(tokens) as n, unnest(tokens) as term, generate_subscripts(tokens, 1) - 1 as pos from token_docs)
  join {name}_words using (term)),
{name}_win as (select distinct paper_id, topic, rank,
    unnest(range(greatest(pos - {window - 1}, 0), least(pos, greatest(n - {window}, 0)) + 1)) as start from {name}_occ),
{name}_total as (select sum(greatest(len(tokens) - {window - 1}, 1))::double as total from token_docs),
{name}_both as (select a.topic, a.rank as i, b.rank as j, count(*) as c from {name}_win a
  join {name}_win b using (paper_id, topic, start) group by all),
{name}_p as (select x.topic, x.rank as i, y.rank as j, coalesce(xy.c, 0) / total as pij, xx.c / total as pi, yy.c / total as pj
  from {name}_words x join {name}_words y on x.topic = y.topic
  left join {name}_both xy on xy.topic = x.topic and xy.i = x.rank and xy.j = y.rank
  left join {name}_both xx on xx.topic = x.topic and xx.i = x.rank and xx.j = x.rank
  left join {name}_both yy on yy.topic = x.topic and yy.i = y.rank and yy.j = y.rank, {name}_total),
{name} as (select topic, i, j, coalesce(ln((pij + 1e-12) / (pi * pj)) / -ln(pij + 1e-12), 0) as npmi from {name}_p)"""


def cv_sql(name: str, pairs: str) -> str:
    return f"""{name}_s as (select *, sum(npmi) over (partition by topic, j) as total from {pairs}),
{name}_w as (select topic, i, coalesce(sum(npmi * total) / nullif(sqrt(sum(npmi * npmi)) * sqrt(sum(total * total)), 0), 0) as c
  from {name}_s group by topic, i),
{name} as (select avg(c) as c_v, count(*) as topics from (select topic, avg(c) as c from {name}_w group by topic))"""


NPMI = f"{TOP_WORDS}, {LETTER_TOKENS}, {npmi_sql('narrow', 10, 15)}"
CV = f"{npmi_sql('wide', 110, 15)}, {cv_sql('cv', 'wide')}"
MEAN_NPMI = "select avg(c) from (select topic, avg(npmi) as c from narrow where i <> j group by topic)"

ORACLES["coherence_npmi"] = f"with {NPMI} select round(({MEAN_NPMI}), 6) as c_npmi"
ORACLES["coherence_cv"] = f"with {TOP_WORDS}, {LETTER_TOKENS}, {CV} select round(c_v, 6) as c_v from cv"
ORACLES["coherence_cv_dictionary"] = f"""
with {SPACE_TOKENS}, {DICTIONARY}, {TOP_WORDS.removeprefix(TOPIC_DOCS + ',')},
{npmi_sql('wide', 110, 10, 'and term in (select term from dictionary)')}, {cv_sql('cv', 'wide')}
select case when topics >= 2 then round(c_v, 6) end as c_v from cv
"""
ORACLES["evaluation_table"] = f"""
with {NPMI}, {CV}, sets as (select topic, list(term) as s from words where topic <> -1 group by topic),
pairs as (select len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) as value
  from sets a, sets b where a.topic < b.topic)
select 'n_topics' as metric, count(distinct topic)::double as value from topic_docs where topic <> -1
union all select 'c_npmi', round(({MEAN_NPMI}), 6)
union all select 'c_v', round(c_v, 6) from cv
union all select 'diversity', round(1 - avg(value), 6) from pairs
"""


def run_sql(run: int) -> str:
    docs = f"run{run}_docs"
    return f"""{docs} as (select paper_id, (paper_id * {run + 2} + topic + 7) % 7 as topic, w from doc_words),
{counts_sql(f'run{run}_counts', docs, '0.95')}, {weights_sql(f'run{run}_weights', f'run{run}_counts')},
{words_sql(f'run{run}_words', f'run{run}_weights')}"""


ORACLES["topic_stability_given"] = f"""
with {TOP_WORDS}, {", ".join(run_sql(r) for r in range(3))},
run_sets as ({" union all ".join(f"select {r} as run, topic, list(term) as s from run{r}_words group by topic" for r in range(3))}),
base_sets as (select topic, list(term) as s from words where topic <> -1 group by topic),
best as (select b.topic, r.run, max(len(list_intersect(b.s, r.s)) / len(list_distinct(list_concat(b.s, r.s)))) as j
  from base_sets b, run_sets r group by b.topic, r.run)
select topic, round(sum(j) / 3, 6) as stability_jaccard from best group by topic
"""


# ---- embeddings -------------------------------------------------------------------------------

def hashed_sql(name: str, tf: str, df: str, n_docs: str, dim: int) -> str:
    """Signed hashed TF-IDF cells of unit length."""
    return f"""{name}_w as (select id, cast(concat('0x', substr(md5(token), 1, 8)) as bigint) % {dim} as bucket,
    case when substr(md5(token), 9, 1) in ('1','3','5','7','9','b','d','f') then -1 else 1 end
      * tf * ln(({n_docs} + 1) / (coalesce(df, 0) + 1)) as w from {tf} left join {df} using (token)),
{name}_b as (select id, bucket, sum(w) as w from {name}_w group by id, bucket),
{name} as (select id, bucket, w / nullif(sqrt(sum(w * w) over (partition by id)), 0) as value from {name}_b)"""


TOKEN_CLASS = r"[\p{L}\p{N}_]{2,}"
ORACLES["embed_documents"] = f"""
with tf as (select id, token, count(*) as tf from (
    select doc_id as id, unnest(regexp_extract_all(lower(text), '{TOKEN_CLASS}')) as token from documents) group by id, token),
df as (select token, count(*) as df from tf group by token),
{hashed_sql('v', 'tf', 'df', '(select count(*) from documents)', 256)}
select id as paper_id, cast(bucket as integer) as bucket, round(cast(cast(value as float) as double), 5) as value
from v where round(cast(cast(value as float) as double), 5) <> 0
"""


def anchor_values() -> str:
    rows = [
        f"({i}, '{name}', '{', '.join(fields)}')" for i, (name, fields) in enumerate(DISCIPLINES.items())
    ]
    return ", ".join(rows)


ORACLES["anchor_text_scores"] = f"""
with papers as ({PAPERS}), anchors(ordinal, discipline, text) as (values {anchor_values()}),
texts as (select paper_id as id, concat(coalesce(title, ''), '. ', coalesce(abstract, '')) as text from papers),
tf as (select id, token, count(*) as tf from (
    select id, unnest(regexp_extract_all(lower(text), '{TOKEN_CLASS}')) as token from texts) group by id, token),
df as (select token, count(*) as df from tf group by token),
anchor_tf as (select id, token, count(*) as tf from (
    select ordinal as id, unnest(regexp_extract_all(lower(text), '{TOKEN_CLASS}')) as token from anchors) group by id, token),
{hashed_sql('v', 'tf', 'df', '(select count(*) from texts)', 256)},
{hashed_sql('a', 'anchor_tf', 'df', '(select count(*) from texts)', 256)},
v32 as (select id, bucket, cast(cast(value as float) as double) as x from v),
a32 as (select id, bucket, cast(cast(value as float) as double) as x from a),
v_len as (select id, sqrt(sum(x * x)) as len from v32 group by id), a_len as (select id, sqrt(sum(x * x)) as len from a32 group by id),
raw as (select v32.id as paper_id, a32.id as ordinal, sum(v32.x * a32.x) as dot from v32 join a32 using (bucket) group by all),
dots as (select paper_id, ordinal, dot / (v_len.len * a_len.len) as sim from raw
  join v_len on v_len.id = paper_id join a_len on a_len.id = ordinal)
select t.id as paper_id, n.ordinal, n.discipline, round(coalesce(d.sim, 0), 6) as sim
from texts t cross join anchors n left join dots d on d.paper_id = t.id and d.ordinal = n.ordinal
"""

ORACLES["embed_with"] = """
select doc_id as paper_id, cast(length(text) as integer) as n_chars,
  cast(length(text) - length(replace(text, ' ', '')) as integer) as n_blanks from documents
"""

ORACLES["merge_topics"] = f"""
with recursive {TOPIC_DOCS}, {SIMILARITY},
edges as (select topic_i as a, topic_j as b from similarity where topic_i <> -1 and topic_j <> -1 and (value >= 0.2 or topic_i = topic_j)),
reach(a, b) as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a)
select a as topic, min(b) as topic_merged from reach group by a
union all select -1, -1
"""



ORACLES["cluster_grid"] = """
with recursive placed as (
  select vec_id, floor(embedding[1]::double / 0.2::double)::bigint as c1, floor(embedding[2]::double / 0.2::double)::bigint as c2,
    floor(embedding[3]::double / 0.2::double)::bigint as c3, floor(embedding[4]::double / 0.2::double)::bigint as c4,
    floor(embedding[5]::double / 0.2::double)::bigint as c5 from embeddings),
dense as (select c1, c2, c3, c4, c5, concat_ws(',', 0, 'c', c1, c2, c3, c4, c5) as cell, count(*) as n from placed group by all having count(*) >= 2),
edges as (select a.cell as a, b.cell as b from dense a join dense b on abs(a.c1 - b.c1) <= 1 and abs(a.c2 - b.c2) <= 1
  and abs(a.c3 - b.c3) <= 1 and abs(a.c4 - b.c4) <= 1 and abs(a.c5 - b.c5) <= 1),
reach(a, b) as (select a, b from edges union select reach.a, edges.b from reach join edges on reach.b = edges.a),
owner as (select a as cell, min(b) as component from reach group by a),
large as (select component, sum(n) as size from dense join owner using (cell) group by component having sum(n) >= 5),
topics as (select component, row_number() over (order by size desc, component) - 1 as topic from large)
select vec_id as paper_id, coalesce(topic, -1)::integer as topic
from placed left join dense using (c1, c2, c3, c4, c5) left join owner using (cell) left join topics using (component)
"""


def reduction_sql(docs: str, tau: float, rounds: int = 8) -> str:
    """Agglomerative rounds spelled out; a round without a mutual pair changes nothing."""
    out = [f"""sum0 as (select topic, dim, sum(x) as x from (select topic, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from {docs})
  where topic <> -1 group by topic, dim),
map0 as (select distinct topic, topic as merged from {docs} where topic <> -1)"""]
    for k in range(rounds):
        out.append(f"""v{k} as (select topic, list(x order by dim) as v from sum{k} group by topic),
pair{k} as (select a.topic as i, b.topic as j, round(list_cosine_similarity(a.v, b.v), 12) as c from v{k} a join v{k} b on a.topic <> b.topic
  where list_cosine_similarity(a.v, b.v) >= {tau}::double),
best{k} as (select i, j from pair{k} qualify row_number() over (partition by i order by c desc, j) = 1),
into{k} as (select a.i, a.j from best{k} a join best{k} b on a.i = b.j and a.j = b.i where a.i < a.j),
sum{k + 1} as (select coalesce(m.i, s.topic) as topic, dim, sum(x) as x from sum{k} s left join into{k} m on m.j = s.topic group by all),
map{k + 1} as (select topic, coalesce(m.i, merged) as merged from map{k} left join into{k} m on m.j = merged)""")
    return ", ".join(out)


ORACLES["reduce_topics"] = f"""
with {TOPIC_DOCS}, {reduction_sql('topic_docs', 0.12)}
select topic, merged as topic_merged from map8 union all select distinct -1, -1 from topic_docs where topic = -1
"""
ORACLES["similar_topics"] = """
select paper_id_i, paper_id_j, round(value, 6) as value from (
  select a.vec_id as paper_id_i, b.vec_id as paper_id_j, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as value
  from embeddings a join embeddings b on a.vec_id < b.vec_id) where value >= 0.3::double
"""

CLEANED_TOPICS = f"""topic_docs as (select * from (select doc_id as paper_id, {cleaned('text')} as text, embedding, case label when 9 then -1 else label end as topic
  from documents join embeddings on doc_id = vec_id) where length(text) >= 50)"""
MERGED_TOPICS = f"""{CLEANED_TOPICS.replace('topic_docs', 'given_docs')}, {reduction_sql('given_docs', 0.12)},
topic_docs as (select paper_id, text, embedding, coalesce(merged, -1) as topic from given_docs left join map8 using (topic))"""
MERGED_WORDS = TOP_WORDS.replace(TOPIC_DOCS, MERGED_TOPICS)
MERGED_OVERLAP = OVERLAP.replace(TOPIC_DOCS, MERGED_TOPICS)

ORACLES["merged_topic_info"] = f"""
with {MERGED_WORDS}, listed as (select topic, string_agg(term, ' ' order by rank) as words from words group by topic),
sizes as (select topic, count(*) as size from topic_docs group by topic)
select topic, size, coalesce(words, '') as words from sizes left join listed using (topic)
"""
ORACLES["merged_topic_overlap"] = f"with {MERGED_OVERLAP} select topic_i, topic_j, round(value, 6) as value from overlap where value > 0"
ORACLES["merged_topic_similarity"] = f"with {MERGED_TOPICS}, {SIMILARITY} select topic_i, topic_j, round(value, 6) as value from similarity"
ORACLES["merged_evaluation"] = f"""
with {MERGED_OVERLAP}, token_docs as (select * from (select paper_id, regexp_extract_all(text, '\\S+') as tokens from topic_docs) where len(tokens) > 10),
{DICTIONARY}, {npmi_sql('wide', 110, 10, 'and term in (select term from dictionary)')}, {cv_sql('cv', 'wide')}
select 'c_v' as metric, case when topics >= 2 then round(c_v, 6) end as value from cv
union all select 'jaccard', round(1 - avg(value), 6) from overlap where topic_i < topic_j and topic_i <> -1
"""

#: Each topic's 30 candidate words with the mean vector of the documents they occur in, the re-ranking, and the greedy
#: choice by marginal relevance as a recursion that adds a word to every topic's list.
ORACLES["topic_info_views"] = f"""
with recursive {TOP_WORDS.replace(TOPIC_DOCS, CLEANED_TOPICS)},
candidate as (select topic, term from weights qualify row_number() over (partition by topic order by weight desc, term) <= 30),
holds as (select distinct paper_id, term from (select paper_id, unnest(w) as term from doc_words) where term in (select term from candidate)),
numbers as (select paper_id, topic, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as dim from topic_docs),
word as (select term, list(x order by dim) as v from (select term, dim, avg(x) as x from holds join numbers using (paper_id) group by all) group by term),
centre as (select topic, list(x order by dim) as v from (select topic, dim, avg(x) as x from numbers group by all) group by topic),
close as (select c.topic, c.term, w.v, round(list_cosine_similarity(w.v, t.v), 12) as c from candidate c join word w using (term) join centre t on t.topic = c.topic),
reranked as (select topic, term, row_number() over (partition by topic order by c desc, term) as rank from close),
likeness as (select a.topic, a.term, any_value(a.c) as c, map(list(b.term order by b.term), list(round(list_cosine_similarity(a.v, b.v), 12) order by b.term)) as m
  from close a join close b on a.topic = b.topic group by a.topic, a.term),
picks(topic, chosen, k) as (
  select topic, [term], 1 from (select topic, term from likeness qualify row_number() over (partition by topic order by (1 - 0.7::double) * c desc, term) = 1)
  union all
  select topic, list_append(chosen, term), k + 1 from (
    select p.topic, p.chosen, p.k, l.term,
      row_number() over (partition by p.topic order by (1 - 0.7::double) * l.c - 0.7::double * list_max(list_transform(p.chosen, lambda t: l.m[t])) desc, l.term) as place
    from picks p join likeness l on l.topic = p.topic and not list_contains(p.chosen, l.term) where p.k < 10)
  where place = 1),
sizes as (select topic, count(*) as size from topic_docs group by topic)
select s.topic, s.size, coalesce((select string_agg(term, ' ' order by rank) from words w where w.topic = s.topic), '') as words,
  coalesce((select string_agg(term, ' ' order by rank) from reranked r where r.topic = s.topic and rank <= 10), '') as reranked,
  coalesce((select array_to_string(arg_max(chosen, k), ' ') from picks p where p.topic = s.topic), '') as diverse
from sizes s
"""

ORACLES["yearly_corpus"] = f"""
with papers as ({PAPERS}), c as (
  select try_cast(pub_year as integer) as pub_year, paper_id,
    {cleaned("concat(coalesce(title, ''), '[SEP]', coalesce(abstract, ''))")} as text from papers)
select pub_year, paper_id, cast(length(text) as integer) as n_chars, md5(text) as text_md5
from c where pub_year is not null and length(text) >= 50
"""
