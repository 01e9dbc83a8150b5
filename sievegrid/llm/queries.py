"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm import ball_kmeans, exact_dedup, gif_media, licences, line_dedup, main_text, mixing, packing, quality_rules, shards, simhash_dedup, source_audit, substring_dedup
from sievegrid.llm.common import scratch_path, table


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in folders source/language/thousands/hundreds of their ids, a third of them at each of the last three depths."""
    key = F.col("doc_id")
    folders = F.array("source", "lang", F.floor(key / 1000).cast("string"), F.floor(key / 100).cast("string"))
    path = F.concat_ws("/", F.slice(folders, F.lit(1), (F.pmod(key, F.lit(3)) + 2).cast("int")), key.cast("string"))
    found = licences.scan(table(spark, sf_dir, "documents"), path)
    return found.withColumn("cosine", F.round("cosine", 6))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = exact_dedup.exact_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    shown = gif_media.gif_frames(gif_media.text_to_gif(docs), canvas=False).withColumn("payload", gif_media.payload_of("frames"))
    bins = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda got, f: F.zip_with(got, f["histogram"], lambda a, b: a + b))
    feature = F.format_string(
        "frames=%d;ms=%d;bins=%s",
        F.size("frames"),
        F.aggregate("frames", F.lit(0), lambda got, f: got + f["delay_ms"]),
        F.array_join(F.filter(F.transform(bins, lambda n, i: F.when(n > 0, F.concat_ws(":", i, n))), lambda x: x.isNotNull()), ","),
    )
    return shown.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def word_bpe_path() -> str:
    """The public tokenizer's file, a parameter of the operators that tokenise."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe_path())


#: Arrivals in which the documents come to the shard table, by remainders of their ids.
ARRIVALS = 4


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in arrivals, are compacted, and are read back through the last manifest."""
    docs = table(spark, sf_dir, "documents")
    shelf = shards.ShardTable(spark, scratch_path(spark, "shards"))
    shelf.append_each(docs, F.pmod("doc_id", F.lit(ARRIVALS)))
    shelf.compact_all()
    return shelf.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labels.where(~quality_rules.held_out(F.col("doc_id"))))
    scored = quality_rules.score(docs, model)
    return scored.select("doc_id", quality_rules.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.seeded(mixing.mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "source", "lang", "topic", "seed", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring_dedup.drop_repeated_windows(docs)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return cut.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op4_mixing": op4_mixing,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_gif_media": op6_gif_media,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_licences": op8_licences,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_source_audit": op12_source_audit,
    "op13_main_text": op13_main_text,
}



def _mixing_sql(rounds: int = mixing.ROUNDS, temper: float = mixing.TEMPER, most: int = mixing.SEEDS, letters: int = mixing.SEED_LETTERS) -> str:
    """Raking written out, one step after another, over the table of cells."""
    dims = ["source", "lang", "topic"]
    steps, last = [], "cells"
    for k in range(rounds * 3):
        d = dims[k % 3]
        rest = " * ".join(f"f_{x}" for x in dims if x != d)
        others = ", ".join(f"f_{x}" for x in dims if x != d)
        steps.append(f"s{k} AS MATERIALIZED (SELECT source, lang, topic, w, total, t_source, t_lang, t_topic, {others}, t_{d} * total / sum(w * {rest}) OVER (PARTITION BY {d}) AS f_{d} FROM {last})")
        last = f"s{k}"
    targets = ", ".join(f"g_{d} AS (SELECT {d}, sum(n_tokens) ^ {temper} / sum(sum(n_tokens) ^ {temper}) OVER () AS t_{d} FROM measured GROUP BY {d} HAVING sum(n_tokens) > 0)" for d in dims)
    return rf"""
        WITH docs AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
        words AS (
            SELECT doc_id, coalesce(lang, 'other') AS l, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\p{{L}}{{{letters},}}') AS ls FROM docs),
        counts AS (SELECT l, w, count(*) AS n FROM (SELECT l, unnest(list_distinct(ls)) AS w FROM words) GROUP BY ALL),
        seeds AS (SELECT l, w, row_number() OVER (PARTITION BY l ORDER BY n DESC, w) AS place FROM counts QUALIFY place <= {most}),
        said AS (SELECT doc_id, l, unnest(ls) AS w FROM words),
        had AS (SELECT doc_id, w, place, count(*) AS n FROM said JOIN seeds USING (l, w) GROUP BY ALL),
        told AS (SELECT doc_id, arg_max(w, (n, -place)) AS seed FROM had GROUP BY doc_id),
        measured AS (
            SELECT doc_id, source, lang, coalesce(seed, 'none') AS seed, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS u,
                   CASE WHEN (length(t) - length(translate(t, '0123456789', ''))) * 40 > length(t) THEN 'figures' WHEN contains(t, '://') OR contains(t, '@') THEN 'web'
                        WHEN contains(t, chr(10)) AND (length(t) - length(replace(t, chr(10), ''))) * 60 >= length(t) THEN 'lines' WHEN length(t) >= 2000 THEN 'long' ELSE 'prose' END AS topic
            FROM docs LEFT JOIN told USING (doc_id)),
        {targets},
        cells AS MATERIALIZED (
            SELECT *, 1.0::DOUBLE AS f_source, 1.0::DOUBLE AS f_lang, 1.0::DOUBLE AS f_topic
            FROM (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w, sum(sum(n_tokens)) OVER ()::DOUBLE AS total
                  FROM measured GROUP BY ALL HAVING sum(n_tokens) > 0)
            JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic)),
        {", ".join(steps)},
        fitted AS (SELECT source, lang, topic, f_source * f_lang * f_topic AS f, max(f_source * f_lang * f_topic) OVER () AS top FROM {last}),
        m AS (SELECT source, any_value(f_source) AS f_source FROM {last} GROUP BY source), n AS (SELECT lang, any_value(f_lang) AS f_lang FROM {last} GROUP BY lang), o AS (SELECT topic, any_value(f_topic) AS f_topic FROM {last} GROUP BY topic),
        p AS (
            SELECT d.*, least(1.0, coalesce((SELECT least(1.0, 1.0 / any_value(top)) FROM fitted), 0) * coalesce(f_source, 0) * coalesce(f_lang, 0) * coalesce(f_topic, 0)) AS probability
            FROM measured d LEFT JOIN m USING (source) LEFT JOIN n USING (lang) LEFT JOIN o USING (topic))
        SELECT doc_id, source, lang, topic, seed, n_tokens, round(probability, 6) AS probability, u < probability AS sampled FROM p
    """


def _licence_sql(threshold: float = licences.THRESHOLD) -> str:
    """Every block and every whole text against every template."""
    sentence = licences.SENTENCE.replace("*+", "*")
    values = ", ".join("({}, '{}', '{}', {})".format(i, name, text.replace("'", "''"), header) for i, (name, text, header) in enumerate(licences.templates()))
    return rf"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS text, array_to_string([source, lang, (doc_id // 1000)::VARCHAR, (doc_id // 100)::VARCHAR][:doc_id % 3 + 2], '/') AS folder,
                   folder || '/' || doc_id AS path FROM documents),
        n AS (SELECT count(*)::DOUBLE AS n FROM docs),
        bags AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{licences.TERM}'))) AS term FROM docs),
        idf AS (SELECT term, 1 + ln((any_value(n) + 1) / (count(*) + 1)) AS idf FROM bags, n GROUP BY term),
        templates(i, licence, words, header) AS (VALUES {values}),
        tf AS (SELECT i, term, count(*) AS tf FROM (SELECT i, unnest(regexp_extract_all(lower(words), '{licences.TERM}')) AS term FROM templates) GROUP BY ALL),
        tw AS (SELECT i, licence, header, term, (1 + ln(tf)) * coalesce(idf, 1 + ln(n + 1)) AS w FROM tf JOIN templates USING (i) LEFT JOIN idf USING (term), n),
        tn AS (SELECT i, sqrt(sum(w * w)) AS norm FROM tw GROUP BY i),
        cut AS (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN len(string_split(l, ' ')) > {licences.LONG_LINE} THEN regexp_extract_all(l, '{sentence}') ELSE [l] END)) AS p FROM docs),
        starts AS (SELECT doc_id, p, unnest(range(len(p))) AS pos FROM cut),
        units AS (
            SELECT doc_id, pos, size, array_to_string(p[pos + 1:pos + size], ' ') AS text FROM starts, range(1, {licences.RUN + 1}) s(size) WHERE pos + size <= len(p)
            UNION ALL SELECT doc_id, -1, 0, text FROM docs),
        terms AS (SELECT doc_id, pos, size, unnest(regexp_extract_all(lower(text), '{licences.TERM}')) AS term FROM units),
        lw AS (SELECT doc_id, pos, size, term, (1 + ln(count(*))) * any_value(idf) AS w FROM terms JOIN idf USING (term) GROUP BY ALL),
        ln AS (SELECT doc_id, pos, size, sqrt(sum(w * w)) AS norm FROM lw GROUP BY ALL),
        dots AS (SELECT doc_id, pos, size, i, any_value(licence) AS licence, sum(lw.w * tw.w) AS dot FROM lw JOIN tw USING (term) WHERE header OR size = 0 GROUP BY doc_id, pos, size, i),
        cosines AS (SELECT doc_id, pos, size, licence, round(dot / ln.norm / tn.norm, 9) AS cosine FROM dots JOIN ln USING (doc_id, pos, size) JOIN tn USING (i)),
        hits AS (SELECT * FROM cosines WHERE cosine >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, pos, size ORDER BY cosine DESC, licence) = 1),
        own AS (SELECT doc_id, arg_min(licence, (-cosine, pos, size, licence)) AS own_licence, max(cosine) AS cosine, bool_or(size = 0) AS is_file FROM hits GROUP BY doc_id),
        files AS (SELECT folder, arg_min(own_licence, (-cosine, doc_id)) AS given FROM docs JOIN own USING (doc_id) WHERE is_file GROUP BY folder),
        near AS (
            SELECT d.doc_id, arg_max(f.folder, len(f.folder)) AS above, arg_max(f.given, len(f.folder)) AS given
            FROM docs d JOIN files f ON d.folder = f.folder OR starts_with(d.folder, f.folder || '/') GROUP BY d.doc_id)
        SELECT doc_id, path, own_licence, round(cosine, 6) AS cosine, coalesce(is_file, false) AS is_file,
               CASE WHEN own_licence IS NULL THEN above END AS inherited_from, coalesce(own_licence, given) AS licence
        FROM docs LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
    """


def _kmeans_sql(k: int = ball_kmeans.CLUSTERS, rounds: int = ball_kmeans.ROUNDS, dims: int = ball_kmeans.DIMENSIONS, scale: int = ball_kmeans.SCALE) -> str:
    """Every vector against every centroid, component by component."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        d{r} AS MATERIALIZED (SELECT vec_id, j, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS distance FROM parts p JOIN c{r} c USING (d) GROUP BY ALL),
        a{r} AS MATERIALIZED (SELECT vec_id, arg_min(j, (distance, j)) AS j, min(distance) AS distance FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""
        m{r} AS (SELECT j, d, sum(x) AS s, count(*) AS n FROM a{r} JOIN parts USING (vec_id) GROUP BY ALL),
        c{r + 1} AS MATERIALIZED (SELECT j, d, coalesce(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END, x)::BIGINT AS x FROM c{r} LEFT JOIN m{r} USING (j, d))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, embedding FROM embeddings
            WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
        parts AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS d, unnest(list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)) AS x FROM kept),
        starts AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {k}),
        c0 AS MATERIALIZED (SELECT j, d, x FROM starts JOIN parts USING (vec_id)),
        {",".join(steps)},
        names AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
        SELECT vec_id, j::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN names USING (j)
    """


def _audit_sql(least: int = source_audit.LEAST_DOCUMENTS, parts: int = source_audit.PARTS, top: int = source_audit.TOP_TERMS) -> str:
    share = f"(1 + ({parts}::HUGEINT * (n + 2)) // (total + 2 * kept))::BIGINT"
    return rf"""
        WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        terms AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{source_audit.UPPER}', '{source_audit.LOWER}'), '{source_audit.TERM}')) AS term FROM docs),
        vocabulary AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
        sizes AS (SELECT lang, count(*)::HUGEINT AS kept, sum(n) AS total FROM vocabulary GROUP BY lang),
        whole AS (SELECT lang, term, {share} AS q FROM vocabulary JOIN sizes USING (lang)),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        counted AS (SELECT lang, source, term, count(*) AS n FROM terms GROUP BY ALL),
        dense AS (SELECT lang, source, term, coalesce(c.n, 0) AS n FROM groups JOIN vocabulary v USING (lang) LEFT JOIN counted c USING (lang, source, term)),
        totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
        shares AS MATERIALIZED (SELECT lang, source, term, n, {share.replace("total", "t.total")} AS p FROM dense JOIN totals t USING (lang, source) JOIN sizes USING (lang)),
        summed AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= {top}
    """


ORACLE_SQL = {
    "op11_ball_kmeans": _kmeans_sql(),
    "op12_source_audit": _audit_sql(),
    "op1_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op8_licences": _licence_sql(),
    "op4_mixing": _mixing_sql(),
    "op2_line_dedup": r"""
        WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text FROM documents),
        split AS (SELECT r, doc_id, string_split(text, chr(10)) AS ls FROM docs),
        lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS line_no FROM split),
        sets AS (SELECT r, doc_id, line, line_no, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS words FROM lines),
        classes AS (
            SELECT row_number() OVER () AS c, words, len(words) AS n, min((doc_id, r, line_no)) AS first
            FROM sets WHERE len(words) > 0 GROUP BY words),
        tokens AS (SELECT c, n, unnest(words) AS w FROM classes WHERE n > 3),
        ranked AS (
            SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY df, w) AS place
            FROM (SELECT *, count(*) OVER (PARTITION BY w) AS df FROM tokens)),
        heads AS (SELECT * FROM ranked WHERE place <= n - (4 * n + 4) // 5 + 1),
        pairs AS (
            SELECT DISTINCT a.c AS a, b.c AS b FROM heads a JOIN heads b ON a.w = b.w AND a.c <> b.c
            WHERE 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
        links AS (
            SELECT x.c, y.first < x.first AS late FROM pairs
            JOIN classes x ON x.c = pairs.a JOIN classes y ON y.c = pairs.b
            WHERE 9 * len(list_intersect(x.words, y.words)) >= 4 * (x.n + y.n)),
        judged AS (SELECT c, count(*) AS links, bool_or(late) AS late FROM links GROUP BY c),
        told AS (
            SELECT s.r, s.doc_id, s.line, s.line_no, coalesce(j.links, 0) AS links,
                   coalesce(j.late, false) OR (k.c IS NOT NULL AND (s.doc_id, s.r, s.line_no) <> k.first) AS goes
            FROM sets s LEFT JOIN classes k ON s.words = k.words LEFT JOIN judged j ON j.c = k.c)
        SELECT doc_id, count(*) AS n_lines, count_if(goes)::BIGINT AS n_removed, sum(links)::BIGINT AS n_links,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT goes), '')) AS kept_sha256
        FROM told GROUP BY r, doc_id
    """,
    "op9_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(body) AS text_sha256
        FROM norm
        WINDOW w AS (PARTITION BY body ORDER BY n_chars DESC, doc_id)
    """,
}
