"""The corpus operators' queries by name. SQL has those whose results DuckDB can express.

Of three operators it can express a part: the llm_ queries are these columns, from the operators' own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import documents
from sparkrecall.llm.conversations import op12_earley_repair
from sparkrecall.llm.lexical import op11_csr_impact_search
from sparkrecall.llm.licenses import license_scan, op3_license_rules
from sparkrecall.llm.linededup import op5_suffix_line_dedup
from sparkrecall.llm.maxent import op8_hashed_maxent
from sparkrecall.llm.media import op2_tar_media
from sparkrecall.llm.mixing import op10_curriculum_mix
from sparkrecall.llm.packing import op7_bound_certified_packing
from sparkrecall.llm.secrets import op13_crf_secrets
from sparkrecall.llm.sharding import op4_hypergeometric_shards
from sparkrecall.llm.simhash import op1_simhash_pivots
from sparkrecall.llm.sketches import op9_iblt_fingerprints, sketched
from sparkrecall.llm.toxicity import op6_nb_ngram_toxicity


def llm_license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def llm_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketched(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def llm_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_curriculum_mix(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_pivots,
        op2_tar_media,
        op3_license_rules,
        op4_hypergeometric_shards,
        op5_suffix_line_dedup,
        op6_nb_ngram_toxicity,
        op7_bound_certified_packing,
        op8_hashed_maxent,
        op9_iblt_fingerprints,
        op10_curriculum_mix,
        op11_csr_impact_search,
        op12_earley_repair,
        op13_crf_secrets,
        llm_license_base,
        llm_edited_texts,
        llm_mix_targets,
    )
}

_IN_PART = "((length({x}) - length(replace({x}, ' ', ''))) // 2)"  # words, each of which has a blank on both sides

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op11_csr_impact_search": f"""with d as (select doc_id, {_TERMS} as w from documents),
s as (select count(*) filter (where len(w) > 0) as n_docs, sum(len(w))::bigint as n_terms from d),
p as (select doc_id, n, term, count(*) as tf from (select doc_id, len(w) as n, unnest(w) as term from d) group by all),
h as (select term, count(*) as df from p group by term),
q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
w as (select item_id, term, times * floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as w from q join h using (term), s),
r as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::bigint as score from w join p using (term), s group by item_id, doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from r where score > 0 qualify rank <= 10""",
    "llm_license_base": f"""with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
s as (select doc_id, len(w) as n, array_to_string(list_transform(w, lambda x: ' ' || x || ' '), '') as s from d),
p as (select doc_id, n, label, k, string_split(s, phrase) as parts from s, (values ('gpl', ' gnu  general  public  license ', 4), ('apache', ' apache  license ', 2), ('cc-by', ' cc  by ', 2), ('mit', ' mit  license ', 2)) as v(label, phrase, k)),
c as (select doc_id, n, label, len(parts) - 1 as m, {_IN_PART.format(x='parts[1]')} as first, n - {_IN_PART.format(x='parts[len(parts)]')} - k as last from p)
select doc_id, any_value(n)::bigint as n_words, sum(m)::bigint as n_base, min(case when m > 0 then first end)::bigint as first_word, max(case when m > 0 then last end)::bigint as last_word,
 coalesce(string_agg(label, ',' order by label) filter (where m > 0), '') as base_labels from c group by doc_id""",
    "llm_edited_texts": """with t as (select doc_id, coalesce(text, '') as t, lead(coalesce(text, '')) over w as after, first_value(coalesce(text, '')) over w as head from documents window w as (order by doc_id)),
n as (select doc_id, t, coalesce(after, head) as n, length(t) as k from t)
select doc_id, k as n_chars, sha256(left(t, k - k // 2) || left(n, k // 2)) as edited_sha256 from n""",
    "llm_mix_targets": r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size) as z from d group by source),
w as (select source, z, case (row_number() over (order by source is null, encode(source)) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
a as (select a.*, (select 1.5 * sum(z) from w) as total, coalesce((select sum(2 * b.z) from w b where b.z / b.w < a.z / a.w), 0) as full_, (select sum(b.w) from w b where b.z / b.w >= a.z / a.w) as open_ from w a),
l as (select arg_min((total - full_) / open_, z / w) filter (where (total - full_) / open_ <= 2.0 * z / w) as level from a)
select doc_id, size::bigint as size, z::bigint as source_size, round(least(2.0 * z, coalesce(level * w, 2.0 * z))::double, 3) as target from d join a on d.source is not distinct from a.source, l""",
}
