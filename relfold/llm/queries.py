"""The registered queries of the operators, and the SQL that defines those which SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relfold.llm import bpe
from relfold.llm.common import held_out, small_batches
from relfold.llm.curriculum import mixed
from relfold.llm.exact_dedup import exact_duplicates
from relfold.llm.language import fit_language, predict_language
from relfold.llm.near import near_duplicates
from relfold.llm.pieces import load_pieces, round_trip
from relfold.llm.quality import fit_quality, with_quality
from relfold.llm.repair import damaged, repair
from relfold.llm.shards import training_shards
from relfold.llm.templates import without_repeated_lines
from relfold.llm.toxicity import fit_toxicity, with_toxicity
from relfold.llm.vantage import nearest_neighbours
from relfold.llm.whitening import whiten

#: A public vocabulary; any SentencePiece model file will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: A public byte-level vocabulary; any plain one in this file format will do.
BYTE_PAIRS = "/opt/tokenizers/byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs, count="dropped").select("doc_id", "dropped", "text")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), load_pieces(VOCABULARY))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    found = predict_language(F.col("text"), fit_language(docs))
    return docs.select("doc_id", held_out().alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", F.col("found")["lang_pred"].alias("lang_pred"), F.col("found")["score"].alias("score")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_shards(table(spark, sf_dir, "documents"), load_pieces(VOCABULARY))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = with_quality(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.load_byte_pairs(BYTE_PAIRS))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).summary


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_templates": op2_line_templates,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language": op4_language,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_token_shards": op6_token_shards,
    "op7_quality": op7_quality,
    "op8_ngram_join": op8_ngram_join,
    "op9_mixing": op9_mixing,
    "op10_neighbours": op10_neighbours,
    "op11_whitening": op11_whitening,
    "op12_bpe": op12_bpe,
    "op13_repair": op13_repair,
}



def _repair_sql() -> str:
    """Repairs row by row: a list of the cheapest edits to each state, as nine digits of cost and the edits, is folded
    over a conversation's rows, with room for inserts in between."""

    def more(key: str, cost: str, letter: str) -> str:
        return f"lpad((left({key}, 9)::int + {cost})::varchar, 9, '0') || substr({key}, 10) || '{letter}'"

    def ways(keys: tuple[int, ...], cost: str, letter: str, given: str = "") -> str:
        return ", ".join(f"case when {given or 'true'} then {more(f'a[{k}]', cost, letter)} end" for k in keys)

    sound, extra = "r[2] in ('0', '3')", "(case when r[2] = '3' then 1 else 0 end)"
    inserted = f"least(a[3], {ways((1, 2, 4), '2', 'I')})"
    opened = [
        more("a[1]", "3", "D"),
        f"least({more('a[2]', '3', 'D')}, {ways((1,), extra, 'K', sound + chr(32) + 'and r[1] = ' + repr('s'))})",
        f"least({more('a[3]', '3', 'D')}, {ways((1, 2, 4), '2 + ' + extra, 'R', sound)}, {ways((1, 2, 4), extra, 'K', sound + chr(32) + 'and r[1] = ' + repr('u'))})",
        f"least({more('a[4]', '3', 'D')}, {ways((3,), '2 + ' + extra, 'R', sound)}, {ways((3,), extra, 'K', sound + chr(32) + 'and r[1] = ' + repr('a'))})",
    ]
    return rf"""
        with crc as (
            select list(v order by i) as t from (
                select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v
                from range(256) r(i))
        ),
        rolled as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint)),
                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 as kind
            from conversations, crc
        ),
        damaged as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role,
                case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
            from rolled
        ),
        ordered as (
            select conv_id, turn, role, text, left(role, 1) as initial,
                row_number() over (partition by conv_id order by turn nulls first, sha256(length(role)::varchar || ':' || role || text), copy) as place
            from damaged
        ),
        faulty as (
            select *, lag(initial) over (partition by conv_id order by place) as before,
                case when not regexp_matches(text, '[^ 	-]') then 1
                    when row_number() over (partition by conv_id, role, text order by place) > 1 then 2
                    when regexp_matches(text, '[^.!? 	-][ 	-]*$') then 3 else 0 end as fault
            from ordered
        ),
        summed as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
                count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
                count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal,
                list([initial, fault::varchar] order by place) as rows, list(role order by place) as roles, list(text order by place) as texts
            from faulty group by conv_id
        ),
        solved as (
            select *, list_reduce(list_prepend(['000000000', null, null, null], flatten(list_transform(rows, lambda r: [['+'], r])) || [['+']]), lambda a, r:
                case when len(r) = 1 then [a[1], a[2], {inserted}, least(a[4], {more(inserted, '2', 'I')})]
                else [{', '.join(opened)}] end) as ends
            from summed
        ),
        repaired as (select * exclude (rows, ends), left(least(ends[1], ends[4]), 9)::bigint as cost, substr(least(ends[1], ends[4]), 10) as audit from solved),
        letters as (select conv_id, audit, roles, texts, unnest(range(1, length(audit) + 1)) as j from repaired),
        spelled as (
            select conv_id, j, audit[j] as letter, roles, texts, length(replace(left(audit, j), 'I', '')) as k, length(replace(left(audit, j), 'D', '')) as o from letters
        ),
        led as (select *, max(case when o = 1 and letter = 'K' and roles[k][1] = 's' then 1 else 0 end) over (partition by conv_id) as system from spelled where letter <> 'D'),
        written as (
            select conv_id, string_agg(case when letter = 'K' then roles[k] when (o - system) % 2 = 1 then 'user' else 'assistant' end
                || ':' || case when letter = 'I' then '' else texts[k] end, chr(10) order by j) as lines
            from led group by conv_id
        )
        select c.conv_id, coalesce(r.gaps, 0)::bigint as gaps, coalesce(r.blank, 0)::bigint as blank, coalesce(r.duplicate, 0)::bigint as duplicate,
            coalesce(r.truncated, 0)::bigint as truncated, coalesce(r.illegal, 0)::bigint as illegal, coalesce(r.cost, 0)::bigint as cost,
            coalesce(r.audit, '') as audit, sha256(coalesce(w.lines, '')) as repaired_sha256
        from (select distinct conv_id from conversations) c left join repaired r on c.conv_id is not distinct from r.conv_id
        left join written w on c.conv_id is not distinct from w.conv_id
    """


ORACLE = {
    "op13_repair": _repair_sql(),
    "op2_line_templates": r"""
        with split as (select doc_id, string_split(text, chr(10)) as lines from documents),
        numbered as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as pos from split),
        worded as (
            select doc_id, pos, list_filter(string_split(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '), lambda t: t <> '') as tokens
            from numbered
        ),
        thin as (select doc_id, pos, array_to_string(tokens, ' ') as line, len(tokens) as size from worded where len(tokens) > 0),
        counted as (select line, size, count(distinct doc_id) as docs, min(doc_id) as first from thin group by all),
        masked as (
            select line, size, docs, list_transform(string_split(line, ' '), lambda t: case when regexp_matches(t, '[0-9@]') then '<*>' else t end) as tokens
            from counted where size >= 4
        ),
        voters as (
            select line, size, docs, tokens, size || ' ' || array_to_string(tokens[1:3], ' ') || chr(10) || k || chr(10)
                || array_to_string(list_filter(tokens, lambda t, i: (i - 1) * 3 // size = k), ' ') as cluster
            from masked, range(3) as parts(k)
        ),
        shared as (select cluster, sum(docs) as cluster_docs from voters group by cluster having sum(docs) >= 3 and count(*) > 1),
        placed as (
            select cluster, cluster_docs, line, docs, unnest(tokens) as token, generate_subscripts(tokens, 1) as spot from voters join shared using (cluster)
        ),
        constants as (
            select cluster, spot, token from placed where token <> '<*>' group by cluster, spot, token
            having sum(docs) >= 0.2e0 * min(cluster_docs) and sum(docs) >= 3
        ),
        templates as (
            select p.cluster, p.line, string_agg(coalesce(c.token, '<*>'), ' ' order by p.spot) as template
            from placed p left join constants c on p.cluster = c.cluster and p.spot = c.spot and p.token = c.token
            where p.docs < 3 group by p.cluster, p.line having count(c.token) >= 0.6e0 * count(*)
        ),
        recurring as (
            select m.cluster, m.template, min(t.doc_id) as first from thin t join templates m using (line)
            group by all having count(distinct t.doc_id) >= 3
        ),
        repeated as (
            select line, first from counted where docs >= 3 or (docs >= 2 and size >= 50)
            union all select line, first from templates join recurring using (cluster, template)
        ),
        drops as (
            select doc_id, list(distinct pos) as gone from thin join repeated using (line) where doc_id <> first group by doc_id
        ),
        kept as (
            select d.doc_id, d.text, coalesce(len(gone), 0)::int as dropped,
                array_to_string(list_filter(string_split(text, chr(10)), lambda line, i: not list_contains(gone, i - 1)), chr(10)) as rest
            from documents d left join drops using (doc_id)
        )
        select doc_id, dropped, case when dropped = 0 then text when regexp_matches(rest, '[^\x20\x09-\x0D]') then rest else '' end as text from kept
    """,
    "op8_ngram_join": r"""
        with recursive worded as (
            select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') as words from documents
        ),
        grams as (
            select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
                else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as gram
            from worded
        ),
        sizes as (select doc_id, count(*) as n from grams group by doc_id),
        met as (
            select a.doc_id as x, b.doc_id as y, count(*) as common
            from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by all
        ),
        edges as (
            select x, y from met join sizes a on a.doc_id = x join sizes b on b.doc_id = y
            where common >= 0.8e0 * (a.n + b.n - common) - 1e-9
        ),
        ways as (select x, y from edges union all select y, x from edges),
        reached as (
            select doc_id, doc_id as other from documents
            union select r.doc_id, w.y from reached r join ways w on r.other = w.x
        )
        select r.doc_id, min(r.other) as class_id, coalesce(max(l.n), 0)::bigint as links
        from reached r left join (select x, count(*) as n from ways group by x) l on l.x = r.doc_id group by r.doc_id
    """,
    "op5_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
        g as (select norm, min(doc_id) as keep_id, count(*) as group_size from n group by norm)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)
    """,
    "op9_mixing": r"""
        with d as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                ('0x' || left(md5(doc_id::varchar), 8))::bigint as draw
            from documents
        ),
        s as (select source, sum(size)::bigint as source_size from d group by source),
        w as (
            select *, 2.0::double * source_size as most,
                [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
            from s
        ),
        l as (
            select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over before, 0))
                / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
            from w window before as (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding)
        ),
        f as (select *, max(case when level * weight < most then level end) over (order by most / weight, source is null, source) as final from l),
        t as (
            select source, source_size,
                case when level * weight >= most or final is null then most else least(final * weight, most) end as target
            from f
        ),
        q as (
            select d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) over (
                partition by d.source order by d.draw, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) + d.size / 2.0 as turn
            from d join t on d.source is not distinct from t.source
        )
        select doc_id, size, source_size, target,
            (size * case when size = 0 then 1 else greatest(ceil((target - turn) / source_size), 0) end)::bigint as taken
        from q
    """,
}
