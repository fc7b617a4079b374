"""DuckDB SQL of the catalog's queries. Fragments are common table expressions; a query names the ones it needs by using them."""

from __future__ import annotations

SPACE = r"[\x09-\x0D\x1C-\x1F\x20\x{85}\p{Z}]"
QUOTE = '"'
CUE = r"cảm ơn|cám ơn|tạm biệt|chào (anh|chị|em|cô|chú|bác|cháu|con)[^\p{L}\p{M}\p{N}_]*\z"


def draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def rank(*parts: str) -> str:
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def _weighted(names: list[str], weights: list[float], at: str) -> str:
    total, upto, out = sum(weights), 0.0, "CASE"
    for n, w in list(zip(names, weights, strict=True))[:-1]:
        upto += w
        out += f" WHEN {at} < {round(upto / total, 9)} THEN '{n}'"
    return f"{out} ELSE '{names[-1]}' END"


_PARTS: list[tuple[str, str]] = [
    ("u0", "SELECT CAST(floor(conv_id / 4) AS BIGINT) AS dialogue_id, conv_id, turn, role, text FROM conversations"),
    ("u1", "SELECT dialogue_id, row_number() OVER (PARTITION BY dialogue_id ORDER BY conv_id, turn, role, text) - 1 AS utt_idx, dense_rank() OVER (PARTITION BY dialogue_id ORDER BY conv_id) - 1 AS seg_rank, conv_id, turn, role, text FROM u0"),
    ("u", "SELECT *, count(*) OVER (PARTITION BY dialogue_id) AS n_utt, max(seg_rank) OVER (PARTITION BY dialogue_id) + 1 AS n_seg, CASE dialogue_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split FROM u1"),
    ("seg", "SELECT split, dialogue_id, seg_rank, min(utt_idx) AS start, max(utt_idx) + 1 AS stop, count(*) AS mass FROM u GROUP BY ALL"),
    ("gold", "SELECT dialogue_id, max(utt_idx) AS gap_idx FROM u WHERE seg_rank < n_seg - 1 GROUP BY dialogue_id, seg_rank"),
    ("tok", r"SELECT dialogue_id, utt_idx, n_utt, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM u"),
    ("term", "SELECT dialogue_id, utt_idx, term, count(*) AS n FROM (SELECT dialogue_id, utt_idx, unnest(w) AS term FROM tok) GROUP BY ALL"),
    ("near", "SELECT dialogue_id, g, term, sum(CASE WHEN g >= utt_idx THEN n ELSE 0 END) AS a, sum(CASE WHEN g < utt_idx THEN n ELSE 0 END) AS b FROM (SELECT *, unnest(range(utt_idx - 2, utt_idx + 2)) AS g FROM term) GROUP BY dialogue_id, g, term"),
    ("cosine", "SELECT dialogue_id, g, sum(a * b) / (greatest(sqrt(sum(a * a)), 1e-8) * greatest(sqrt(sum(b * b)), 1e-8)) AS c FROM near GROUP BY dialogue_id, g"),
    ("co", "SELECT dialogue_id, utt_idx AS g, list_distinct(w) AS a, list_distinct(lead(w) OVER (PARTITION BY dialogue_id ORDER BY utt_idx)) AS b, n_utt FROM tok"),
    ("gs", "SELECT co.dialogue_id, co.g AS gap_idx, CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN (len(a) + len(b) - len(list_distinct(list_concat(a, b)))) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS coherence, coalesce(c, 0.0) AS topic_cos FROM co LEFT JOIN cosine ON co.dialogue_id = cosine.dialogue_id AND co.g = cosine.g WHERE co.g < n_utt - 1"),
    ("sc", "SELECT *, round(1 / (1 + exp(-(coherence + 1.0::DOUBLE * topic_cos))), 9) AS score FROM gs"),
    ("d0", "SELECT *, lag(score) OVER w AS before, lead(score) OVER w AS after FROM sc WINDOW w AS (PARTITION BY dialogue_id ORDER BY gap_idx)"),
    ("d1", "SELECT *, CASE WHEN before IS NULL OR before < score THEN score END AS le, CASE WHEN after IS NULL OR after < score THEN score END AS re FROM d0"),
    ("dp", "SELECT dialogue_id, gap_idx, score, round(0.5 * (last_value(le IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY gap_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + first_value(re IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY gap_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * score), 9) AS depth FROM d1"),
    ("top", "SELECT * FROM (SELECT dp.*, row_number() OVER (PARTITION BY dp.dialogue_id ORDER BY depth DESC, gap_idx DESC) AS rank, k FROM dp JOIN (SELECT DISTINCT dialogue_id, n_seg - 1 AS k FROM u) USING (dialogue_id)) WHERE rank <= k"),
    ("hyp", "SELECT u.*, CAST(coalesce(sum(CASE WHEN top.gap_idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.dialogue_id ORDER BY u.utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hyp FROM u LEFT JOIN top ON u.dialogue_id = top.dialogue_id AND u.utt_idx = top.gap_idx"),
    ("even0", "SELECT DISTINCT dialogue_id, CAST(round_even(j * n_utt / CAST(n_seg AS DOUBLE), 0) AS BIGINT) - 1 AS gap_idx FROM (SELECT dialogue_id, n_utt, n_seg, unnest(range(1, n_seg)) AS j FROM (SELECT DISTINCT dialogue_id, n_utt, least(n_seg, n_utt) AS n_seg FROM u))"),
    ("even", "SELECT u.*, CAST(coalesce(sum(CASE WHEN e.gap_idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY u.dialogue_id ORDER BY u.utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hyp FROM u LEFT JOIN even0 e ON u.dialogue_id = e.dialogue_id AND u.utt_idx = e.gap_idx"),
    ("stride", "SELECT u.*, utt_idx // (SELECT greatest(1, CAST(round_even(avg(mass), 0) AS BIGINT)) FROM seg WHERE split = 'train') AS hyp FROM u"),
    ("rnd0", f"SELECT u.*, s, utt_idx < n_utt - 1 AS gap, row_number() OVER (PARTITION BY dialogue_id, s, utt_idx < n_utt - 1 ORDER BY {rank(repr('baseline'), 's', 'dialogue_id', 'utt_idx')}) AS place FROM u, range(20) r(s)"),
    ("rnd", "SELECT * EXCLUDE (place, gap), CAST(coalesce(sum(CASE WHEN gap AND place <= least(n_seg - 1, n_utt - 1) THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id, s ORDER BY utt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hyp FROM rnd0"),
]


def _score(name: str, src: str, key: str = "dialogue_id") -> tuple[str, str]:
    on = " AND ".join(f"a.{k} = b.{k}" for k in key.split(", "))
    keys = ", ".join(f"a.{k}" for k in key.split(", "))
    return name, (
        f"SELECT {keys}, a.n_utt, a.n_seg, coalesce(avg(CASE WHEN b.hyp IS NULL THEN NULL WHEN (a.seg_rank = b.seg_rank) <> (a.hyp = b.hyp) THEN 1.0 ELSE 0.0 END), 0) AS pk, "
        f"coalesce(avg(CASE WHEN b.hyp IS NULL THEN NULL WHEN (b.seg_rank - a.seg_rank) <> (b.hyp - a.hyp) THEN 1.0 ELSE 0.0 END), 0) AS wd "
        f"FROM (SELECT *, utt_idx + greatest(2, CAST(round_even(n_utt / n_seg / 2, 0) AS BIGINT)) AS j FROM {src} WHERE n_utt >= 2) a LEFT JOIN {src} b ON {on} AND a.j = b.utt_idx GROUP BY {keys}, a.n_utt, a.n_seg"
    )


_NEG, _FAR, _HARD = (draw("'3407'", f"'{x}'", "dialogue_id", "utt_idx") for x in ("neg", "far", "hard"))
_PARTS += [
    _score("m_lex", "hyp"),
    _score("m_even", "even"),
    _score("m_stride", "stride"),
    _score("m_rnd0", "rnd", "dialogue_id, s"),
    ("m_rnd", "SELECT dialogue_id, n_utt, n_seg, avg(pk) AS pk, avg(wd) AS wd FROM m_rnd0 GROUP BY ALL"),
    ("clean", rf"SELECT * REPLACE (regexp_replace(text, '{SPACE}([,?.!{QUOTE}](?:{SPACE}|\z))', '\1', 'g') AS text) FROM u"),
    ("run", "SELECT dialogue_id, utt_idx, array_to_string(list(text) OVER (PARTITION BY dialogue_id, seg_rank ORDER BY utt_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), ' | ') AS run, array_to_string(list(text) OVER (PARTITION BY dialogue_id ORDER BY utt_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), ' | ') AS ctx FROM clean"),
    ("anc0", "SELECT *, lead(seg_rank) OVER (PARTITION BY dialogue_id ORDER BY utt_idx) AS nx FROM u"),
    ("anc1", f"SELECT a.dialogue_id, a.utt_idx, a.n_utt, a.n_seg, s.start, s.stop, p.start AS ps, p.stop AS pe, greatest(a.utt_idx - 1, 0) AS lf, greatest(a.n_utt - a.utt_idx - 3, 0) AS rt FROM anc0 a JOIN seg s ON a.dialogue_id = s.dialogue_id AND a.seg_rank = s.seg_rank LEFT JOIN seg p ON a.dialogue_id = p.dialogue_id AND a.seg_rank = p.seg_rank + 1 WHERE a.nx = a.seg_rank"),
    ("anc2", f"SELECT *, CASE WHEN n_utt - (stop - start) > 0 THEN {_NEG} % greatest(n_utt - (stop - start), 1) END AS r, CASE WHEN lf + rt > 0 THEN {_FAR} % greatest(lf + rt, 1) END AS q, CASE WHEN pe > ps THEN ps + {_HARD} % greatest(pe - ps, 1) END AS back FROM anc1"),
    ("anc", "SELECT dialogue_id, utt_idx AS anchor_idx, CASE WHEN n_seg = 1 THEN coalesce(CASE WHEN q < lf THEN q ELSE q - lf + utt_idx + 3 END, utt_idx) WHEN r < start THEN r ELSE r + stop - start END AS neg_idx, CASE WHEN n_seg = 1 THEN coalesce(CASE WHEN q < lf THEN q ELSE q - lf + utt_idx + 3 END, utt_idx) WHEN stop < n_utt THEN stop ELSE back END AS hard_idx FROM anc2"),
    ("mined", "SELECT anc.*, c.ctx AS context, p.run AS pos, n.run AS neg, h.run AS hard FROM anc JOIN run c ON anc.dialogue_id = c.dialogue_id AND anchor_idx = c.utt_idx JOIN run p ON anc.dialogue_id = p.dialogue_id AND anchor_idx + 1 = p.utt_idx JOIN run n ON anc.dialogue_id = n.dialogue_id AND neg_idx = n.utt_idx JOIN run h ON anc.dialogue_id = h.dialogue_id AND hard_idx = h.utt_idx"),
    ("key", r"SELECT split, dialogue_id, seg_rank, count(*) AS mass, regexp_extract(lower(arg_min(text, utt_idx)), '[\p{L}\p{M}\p{N}_]+') AS opener, md5(string_agg(md5(text), ',' ORDER BY utt_idx)) AS seg_key FROM u GROUP BY split, dialogue_id, seg_rank"),
    ("norm", f"SELECT split, md5(lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g')))) AS t FROM u"),
    ("uses", "SELECT split, seg_key, count(*) AS n FROM key GROUP BY ALL"),
    ("div", "SELECT * FROM (SELECT split, CAST(sum(n) AS BIGINT) AS segments, count(*) AS distinct_segments, avg(n) AS mean_uses, max(n) AS max_uses FROM uses GROUP BY split) JOIN (SELECT split, count(DISTINCT dialogue_id) AS sessions, CAST(sum(again) AS BIGINT) AS in_session_repeats FROM (SELECT split, dialogue_id, seg_key, count(*) - 1 AS again FROM key GROUP BY ALL) GROUP BY split) USING (split) JOIN (SELECT split, count(DISTINCT t) AS distinct_utterances FROM norm GROUP BY split) USING (split)"),
    ("len", "SELECT split, avg(mass) AS seg_len_mean, stddev_pop(mass) AS seg_len_std, min(mass) AS seg_len_min, max(mass) AS seg_len_max FROM seg GROUP BY split"),
    ("opn", "SELECT split, opener, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY split) AS BIGINT) AS share FROM key GROUP BY split, opener"),
    ("jsx", "SELECT s.split, coalesce(o.share, 0) AS a, coalesce(b.share, 0) AS b FROM (SELECT DISTINCT split FROM opn WHERE split <> 'train') s CROSS JOIN (SELECT DISTINCT opener FROM opn) n LEFT JOIN opn o ON o.split = s.split AND o.opener = n.opener LEFT JOIN opn b ON b.split = 'train' AND b.opener = n.opener"),
    ("js", "SELECT split, sum(CASE WHEN a > 0 THEN 0.5 * a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN 0.5 * b * log2(b / ((a + b) / 2)) ELSE 0 END) AS opener_js FROM jsx GROUP BY split"),
    ("cue0", f"SELECT u.split, utt_idx = stop - 1 AS last, CASE WHEN regexp_matches(lower(text), '{CUE}') THEN 1.0 ELSE 0.0 END AS hit FROM u JOIN seg USING (dialogue_id, seg_rank)"),
    ("cue", "SELECT split, coalesce(avg(hit) FILTER (last), 0) AS final_rate, coalesce(avg(hit) FILTER (NOT last), 0) AS other_rate FROM cue0 GROUP BY split"),
    ("ov0", "SELECT DISTINCT 'segments' AS kind, seg_key AS key, split FROM key UNION ALL SELECT DISTINCT 'utterances', t, split FROM norm"),
    ("ov", "SELECT a.split AS split_a, b.split AS split_b, count(*) FILTER (a.kind = 'segments') AS shared_segments, count(*) FILTER (a.kind = 'utterances') AS shared_utterances FROM ov0 a JOIN ov0 b ON a.kind = b.kind AND a.key = b.key AND a.split < b.split GROUP BY ALL"),
    ("bl", "SELECT split, 'even' AS kind, avg(pk) AS pk FROM m_even JOIN (SELECT DISTINCT dialogue_id, split FROM u) USING (dialogue_id) GROUP BY split UNION ALL SELECT split, 'stride', avg(pk) FROM m_stride JOIN (SELECT DISTINCT dialogue_id, split FROM u) USING (dialogue_id) GROUP BY split"),
    ("doc", "SELECT doc_id, source AS domain, lang, n_chars FROM documents"),
    ("spl0", f"SELECT *, domain IN ('src0', 'src1') AS ood, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY {rank(repr('42'), repr('held'), 'doc_id')}, doc_id) AS h, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS r FROM doc"),
    ("spl", "SELECT doc_id, s.domain, lang, n_chars, CASE WHEN ood THEN CASE WHEN r % 2 = 1 THEN 'val_ood' ELSE 'test_ood' END WHEN n >= 3 AND h = 1 THEN CASE WHEN flip % 2 = 1 THEN 'val_in' ELSE 'test_in' END ELSE 'train' END AS split FROM spl0 s LEFT JOIN (SELECT domain, row_number() OVER (ORDER BY domain) AS flip FROM spl0 WHERE NOT ood AND n >= 3 AND h = 1) f ON s.domain = f.domain"),
    ("job0", "SELECT *, doc_id || '_' || printf('%02d', idx) AS job_id, ['lang: ' || lang, 'source: ' || domain, 'chars: ' || n_chars, 'id: ' || doc_id] AS facts FROM (SELECT *, unnest(range(8)) AS idx FROM spl)"),
    ("job1", f"SELECT *, {draw(repr('42'), repr('turns'), 'job_id')} % 10 + 3 AS num_turns, {draw(repr('42'), repr('closing'), 'job_id')} / 4294967296.0::DOUBLE AS ca, {draw(repr('42'), repr('opener'), 'job_id')} / 4294967296.0::DOUBLE AS oa FROM job0"),
    ("job", f"SELECT *, greatest(1, least(4, greatest(num_turns // 2, 1) + {draw(repr('42'), repr('facts'), 'job_id')} % 3 - 1)) AS k, ['student', 'worker', 'middle_aged', 'elderly', 'young_with_elder', 'shop_owner', 'for_parents', 'migrant_worker'][{draw(repr('42'), repr('persona'), 'job_id')} % 8 + 1] AS persona, {_weighted(['greet', 'direct', 'situation', 'follow_on', 'paperwork'], [0.20, 0.25, 0.25, 0.15, 0.15], 'oa')} AS opener, CASE WHEN num_turns % 2 = 1 THEN {_weighted(['thanks', 'confirms', 'plans'], [0.35, 0.35, 0.30], 'ca')} ELSE {_weighted(['advises', 'stops'], [0.15, 0.85], 'ca')} END AS closing, num_turns >= 6 AND {draw(repr('42'), repr('clarify'), 'job_id')} / 4294967296.0::DOUBLE < 0.3 AS clarify FROM job1"),
    ("dlg", "SELECT conv_id, count(*) AS n_turns, CAST(to_json({'utterances': list({'speaker': CASE role WHEN 'user' THEN 'citizen' WHEN 'assistant' THEN 'officer' ELSE role END, 'text': text} ORDER BY turn, role, text)}) AS VARCHAR) AS js FROM conversations GROUP BY conv_id"),
    ("dlg2", "SELECT *, lpad(CAST(conv_id AS VARCHAR), 12, '0') AS job_id FROM dlg UNION ALL SELECT *, lpad(CAST(conv_id + 500000000000 AS VARCHAR), 12, '0') FROM dlg WHERE conv_id % 10 = 0"),
    ("rep0", "SELECT job_id, conv_id, n_turns + CASE WHEN conv_id % 7 = 3 THEN 3 ELSE 0 END AS num_turns, CASE conv_id % 11 WHEN 1 THEN 'Here: ```json' || chr(10) || js || chr(10) || '``` done' WHEN 2 THEN left(js, length(js) - 3) || '}' WHEN 3 THEN '{\"other\": 1}' WHEN 4 THEN 'no reply today' ELSE js END AS output FROM dlg2"),
    ("rep1", r"SELECT *, CASE WHEN regexp_matches(output, '(?s)```(?:json)?\s*(.*?)```') THEN trim(regexp_extract(output, '(?s)```(?:json)?\s*(.*?)```', 1)) ELSE trim(output) END AS body FROM rep0 WHERE conv_id % 11 <> 0"),
    ("rep2", "SELECT *, CASE WHEN strpos(body, '{') > 0 AND strpos(body, '}') > 0 THEN substr(body, strpos(body, '{'), length(body) - strpos(reverse(body), '}') + 2 - strpos(body, '{')) END AS j FROM rep1"),
    ("rep3", "SELECT *, CASE WHEN j IS NULL THEN 'no_json' WHEN NOT json_valid(j) THEN 'bad_json' WHEN json_type(j, '$.utterances') IS DISTINCT FROM 'ARRAY' OR json_array_length(j, '$.utterances') = 0 THEN 'no_utterances' END AS parse_error FROM rep2"),
    ("trn", "SELECT job_id, unnest(range(CAST(json_array_length(j, '$.utterances') AS BIGINT))) AS i, j FROM rep3 WHERE parse_error IS NULL"),
    ("trn2", "SELECT job_id, i, json_extract_string(j, '$.utterances[' || i || '].speaker') AS speaker, json_extract_string(j, '$.utterances[' || i || '].text') AS text FROM trn"),
    ("trn3", r"SELECT job_id, i, trim(text) AS t, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty_turn' WHEN speaker IS DISTINCT FROM (CASE WHEN i % 2 = 0 THEN 'citizen' ELSE 'officer' END) THEN 'speaker_order' WHEN regexp_matches(text, '(?m)(\*\*|^#+\s|^\s*[-*•]\s|^\s*\d+[.)]\s)') THEN 'markdown' END AS fault FROM trn2"),
    ("flt", "SELECT job_id, count(*) AS got, arg_min(fault, i) FILTER (fault IS NOT NULL) AS fault, list(t ORDER BY i) AS key FROM trn3 GROUP BY job_id"),
    ("out0", "SELECT r0.job_id, CASE WHEN r0.conv_id % 17 = 5 AND r0.job_id < '500' THEN 'already_ingested' WHEN r3.job_id IS NULL THEN 'missing_reply' WHEN parse_error IS NOT NULL THEN parse_error WHEN fault IS NOT NULL THEN fault WHEN abs(got - r0.num_turns) > 1 THEN 'turn_count' END AS reason, CASE WHEN parse_error IS NULL AND NOT (r0.conv_id % 17 = 5 AND r0.job_id < '500') THEN got - r0.num_turns END AS drift, key FROM rep0 r0 LEFT JOIN rep3 r3 USING (job_id) LEFT JOIN flt USING (job_id)"),
    ("outc", "SELECT job_id, drift, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, key ORDER BY job_id) > 1 THEN 'duplicate' ELSE 'accepted' END) AS outcome FROM out0"),
    ("drp0", "SELECT dialogue_id, seg_rank, count(*) AS n, max_by(role, turn) AS lr, max(n_seg) AS n_seg FROM u GROUP BY ALL"),
    ("drp", "SELECT *, n - CASE WHEN seg_rank < n_seg - 1 AND n > 2 AND lr = 'user' THEN 1 ELSE 0 END AS m FROM drp0"),
    ("cnt", r"SELECT dialogue_id, split, CAST(sum(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens FROM u GROUP BY dialogue_id, split"),
    ("ql", "SELECT list_sort(list(n_tokens)) AS l, count(*) AS n FROM cnt WHERE split = 'train'"),
    ("bkt", "SELECT dialogue_id, n_tokens, CASE WHEN n_tokens <= l[CAST(floor(0.25 * n) AS BIGINT) + 1] THEN 0 WHEN n_tokens <= l[CAST(floor(0.5 * n) AS BIGINT) + 1] THEN 1 WHEN n_tokens <= l[CAST(floor(0.75 * n) AS BIGINT) + 1] THEN 2 ELSE 3 END AS bucket FROM cnt, ql WHERE split <> 'train'"),
    ("dif", "SELECT b.dialogue_id, 'pk' AS metric, b.pk AS base, c.pk AS cand, round(c.pk - b.pk, 9) AS diff FROM m_even b JOIN m_lex c USING (dialogue_id) UNION ALL SELECT b.dialogue_id, 'wd', b.wd, c.wd, round(c.wd - b.wd, 9) FROM m_even b JOIN m_lex c USING (dialogue_id)"),
    ("bt0", "SELECT metric, diff, row_number() OVER (PARTITION BY metric ORDER BY dialogue_id) - 1 AS place, count(*) OVER (PARTITION BY metric) AS n FROM dif"),
    ("bt", f"SELECT s.metric, boot, round(sum(d.diff) / max(s.n), 9) AS mean FROM (SELECT metric, n, place AS slot, boot, {draw(repr('0'), 'boot', 'place')} % n AS pick FROM bt0, range(10000) b(boot)) s JOIN bt0 d ON s.metric = d.metric AND s.pick = d.place GROUP BY s.metric, boot"),
    ("wx0", "SELECT metric, abs(diff) AS a, count(*) AS t, count(*) FILTER (diff > 0) AS up FROM dif WHERE diff <> 0 GROUP BY ALL"),
    ("wx1", "SELECT *, coalesce(sum(t) OVER (PARTITION BY metric ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM wx0"),
    ("wx2", "SELECT metric, CAST(sum(t) AS DOUBLE) AS n, least(sum(r * up), sum(r * (t - up))) AS w, CAST(sum(t * t * t - t) AS DOUBLE) AS tied FROM wx1 GROUP BY metric"),
    ("wx3", "SELECT *, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tied / 48) AS z FROM wx2"),
    ("prm", f"""SELECT *, ['em', 'em', 'cháu', 'cháu', 'tôi', 'tôi'][a] AS own, ['anh', 'chị', 'cô', 'chú', 'anh', 'chị'][a] AS other, CASE WHEN b = 0 THEN 'trả lời ngắn' ELSE 'trả lời đủ ý' END AS answers, list_transform(list_sort(list_transform(facts, lambda x: md5('42|' || job_id || '|' || x) || x))[:k], lambda y: '- ' || substr(y, 33)) AS used
      FROM (SELECT *, {draw(repr('42'), repr('address'), 'job_id')} % 6 + 1 AS a, {draw(repr('42'), repr('answers'), 'job_id')} % 2 AS b FROM job)"""),
    ("ps0", "SELECT vec_id // 16 AS win, vec_id % 16 AS i, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings"),
    ("ps1", "SELECT win, i, dim, avg(x) OVER (PARTITION BY win, dim ORDER BY i ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a, avg(x) OVER (PARTITION BY win, dim ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM ps0"),
    ("ps2", "SELECT win, i, round(1 / (1 + exp(-sum(a * b) / (greatest(sqrt(sum(a * a)), 1e-8) * greatest(sqrt(sum(b * b)), 1e-8)))), 9) AS score FROM ps1 WHERE b IS NOT NULL GROUP BY win, i"),
    ("ps3", "SELECT *, CASE WHEN coalesce(lag(score) OVER o < score, true) THEN score END AS le, CASE WHEN coalesce(lead(score) OVER o < score, true) THEN score END AS re FROM ps2 WINDOW o AS (PARTITION BY win ORDER BY i)"),
    ("ps4", "SELECT win, i, round(0.5 * (last_value(le IGNORE NULLS) OVER (PARTITION BY win ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + first_value(re IGNORE NULLS) OVER (PARTITION BY win ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 * score), 9) AS depth FROM ps3"),
    ("e", "SELECT vec_id, vec_id // 16 AS win, vec_id // 64 AS batch, vec_id % 16 AS i, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"),
    ("pc", "SELECT a.win, a.i, b.i AS j, a.label = b.label AS same, list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-8) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-8)) AS cos FROM e a JOIN e b ON a.win = b.win AND a.i <> b.i"),
    ("ml", "SELECT p.win, p.i, avg(greatest(0.0, 1.0 - (p.cos - n.cos))) AS loss FROM pc p JOIN pc n ON p.win = n.win AND p.i = n.i AND p.same AND NOT n.same GROUP BY ALL"),
    ("sup", "SELECT win, i, log_sum - pos AS loss FROM (SELECT win, i, max(cos / 0.1::DOUBLE) + ln(sum(exp(cos / 0.1::DOUBLE - m))) AS log_sum, avg(cos / 0.1::DOUBLE) FILTER (same) AS pos, count(*) FILTER (same) AS np, count(*) FILTER (NOT same) AS nn FROM (SELECT *, max(cos / 0.1::DOUBLE) OVER (PARTITION BY win, i) AS m FROM pc) GROUP BY win, i) WHERE np > 0 AND nn > 0"),
    ("e2", "SELECT *, CASE WHEN lag(label) OVER (PARTITION BY win ORDER BY i) IS DISTINCT FROM label THEN i END AS mark, count(*) OVER (PARTITION BY win) AS size FROM e"),
    ("e3", "SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY win ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS lf, coalesce(first_value(mark IGNORE NULLS) OVER (PARTITION BY win ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), size) AS rt FROM e2"),
    ("tm0", "SELECT a.batch, a.vec_id AS i, CASE WHEN a.win = b.win AND b.i >= greatest(a.lf, a.i - 5) AND b.i < least(a.rt, a.i + 6) AND b.i <> a.i THEN true WHEN a.win <> b.win OR b.i < least(a.lf, a.i - 5) OR b.i >= greatest(a.rt, a.i + 6) THEN false END AS same, list_dot_product(a.v, b.v) / (greatest(sqrt(list_dot_product(a.v, a.v)), 1e-8) * greatest(sqrt(list_dot_product(b.v, b.v)), 1e-8)) AS cos FROM e3 a JOIN e b ON a.batch = b.batch"),
    ("tm", "SELECT p.batch, p.i, avg(greatest(0.0, 1.0 - (p.cos - n.cos))) AS loss FROM tm0 p JOIN tm0 n ON p.batch = n.batch AND p.i = n.i AND p.same AND NOT n.same GROUP BY ALL"),
    ("ep0", "SELECT user_id % 5 AS run, event_id % 12 AS epoch, count(*) AS n_steps, round(avg(value), 9) AS val_pk FROM events GROUP BY ALL"),
    ("ep1", "SELECT *, min(val_pk) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(val_pk) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM ep0"),
    ("ep2", "SELECT *, before IS NULL OR val_pk < before AS is_best, sum(CASE WHEN before IS NULL OR val_pk < before THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ep1"),
    ("ep3", "SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - 1 AS bad FROM ep2"),
]
_WITH = "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in _PARTS) + "\n"
_IDS = rf"list_transform(list_filter(regexp_split_to_array(lower({{}}), '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda w: CAST('0x' || substr(md5('vocabulary|' || w), 1, 8) AS BIGINT) % 30000 + 1000)"
_ENC = f"""e0 AS (SELECT dialogue_id, utt_idx AS gap_idx, n_utt, {_IDS.format('text')} AS w FROM u),
e1 AS (SELECT dialogue_id, gap_idx, n_utt, list_concat(CASE WHEN lag(w) OVER o IS NULL THEN [] ELSE list_append(lag(w) OVER o, 102) END, list_append(w, 102)) AS c, list_concat(list_append(lead(w, 1) OVER o, 102), CASE WHEN lead(w, 2) OVER o IS NULL THEN [] ELSE list_append(lead(w, 2) OVER o, 102) END) AS f FROM e0 WINDOW o AS (PARTITION BY dialogue_id ORDER BY gap_idx)),
e2x AS (SELECT *, least(len(c), greatest(62 - len(f), 31)) AS kc FROM e1 WHERE gap_idx < n_utt - 1),
enc AS (SELECT dialogue_id, gap_idx, kc AS keep_context, least(len(f), 62 - kc) AS keep_next, list_concat([101], c[len(c) - kc + 1:], f[:least(len(f), 62 - kc)], [102]) AS ids FROM e2x)
"""


def _q(select: str, more: str = "") -> str:
    return _WITH.rstrip() + (",\n" + more if more else "\n") + select


def _metric(src: str) -> str:
    return _q(f"SELECT dialogue_id, n_utt, n_seg, round(pk, 6) AS pk, round(wd, 6) AS wd FROM {src}")


ORACLE_SQL: dict[str, str] = {
    "session_utterances": _q("SELECT dialogue_id, utt_idx, seg_rank, role, text FROM u"),
    "segment_masses": _q("SELECT dialogue_id, seg_rank, start, stop, mass FROM seg"),
    "segment_starts": _q("SELECT dialogue_id, start FROM seg UNION ALL SELECT DISTINCT dialogue_id, n_utt FROM u"),
    "gold_boundaries": _q("SELECT * FROM gold"),
    "context_windows": _q(f"SELECT dialogue_id, utt_idx, array_to_string(list(text) OVER (PARTITION BY dialogue_id ORDER BY utt_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), ' | ') AS context FROM u"),
    "continuation_windows": _q("SELECT dialogue_id, utt_idx, array_to_string(list(text) OVER (PARTITION BY dialogue_id, seg_rank ORDER BY utt_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), ' | ') AS continuation FROM u"),
    "gap_windows": _q("SELECT dialogue_id, gap_idx, context, following FROM (SELECT dialogue_id, utt_idx AS gap_idx, n_utt, array_to_string(list(text) OVER (PARTITION BY dialogue_id ORDER BY utt_idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), ' | ') AS context, array_to_string(list(text) OVER (PARTITION BY dialogue_id ORDER BY utt_idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ' | ') AS following FROM u) WHERE gap_idx < n_utt - 1"),
    "topic_windows": _q("SELECT dialogue_id, utt_idx AS anchor_idx, utt_idx + 1 - greatest(utt_idx - 2, 0) AS mid, texts, segs FROM (SELECT *, md5(array_to_string(list(text) OVER o, ' | ')) AS texts, array_to_string(list(seg_rank) OVER o, ',') AS segs, lead(seg_rank) OVER (PARTITION BY dialogue_id ORDER BY utt_idx) AS nx FROM u WINDOW o AS (PARTITION BY dialogue_id ORDER BY utt_idx ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)) WHERE nx = seg_rank"),
    "clean_punctuation": _q("SELECT conv_id, turn, text FROM clean"),
    "normalize_text": _q(f"SELECT conv_id, turn, lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) AS text FROM conversations"),
    "opener_words": _q("SELECT split, opener, n, round(share, 6) AS share FROM opn"),
    "top_openers": _q("SELECT opener, CAST(sum(n) AS BIGINT) AS n FROM opn GROUP BY opener ORDER BY n DESC, opener LIMIT 8"),
    "closing_cue_rates": _q("SELECT split, round(final_rate, 6) AS final_rate, round(other_rate, 6) AS other_rate FROM cue"),
    "gap_scores": _q("SELECT dialogue_id, gap_idx, round(coherence, 6) AS coherence, round(topic_cos, 6) AS topic_cos, round(score, 6) AS score FROM sc"),
    "depth_scores": _q("SELECT dialogue_id, gap_idx, round(score, 6) AS score, round(depth, 6) AS depth FROM dp"),
    "topk_boundaries": _q("SELECT dialogue_id, gap_idx, rank FROM top"),
    "predicted_masses": _q("SELECT dialogue_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY hyp) AS masses FROM (SELECT dialogue_id, hyp, count(*) AS n FROM hyp GROUP BY ALL) GROUP BY dialogue_id"),
    "pk_windowdiff_per_doc": _metric("m_lex"),
    "pk_windowdiff_macro": _q("SELECT count(*) AS n_docs, round(avg(pk), 6) AS pk, round(avg(wd), 6) AS wd FROM m_lex"),
    "baseline_even": _metric("m_even"),
    "baseline_stride": _metric("m_stride"),
    "baseline_random": _metric("m_rnd"),
    "mine_samples": _q("SELECT * FROM mined"),
    "sample_pairs": _q("SELECT dialogue_id, anchor_idx, 'neg' AS pair, context, pos, neg AS other FROM mined UNION ALL SELECT dialogue_id, anchor_idx, 'hard', context, pos, hard FROM mined"),
    "truncate_pairs": _q("SELECT dialogue_id, gap_idx, keep_context, keep_next, array_to_string(ids, ',') AS input_ids FROM enc", _ENC),
    "pad_and_mask": _q("SELECT dialogue_id, gap_idx, array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda x: 0)), ',') AS input_ids, array_to_string(list_concat(list_transform(range(keep_context + 1), lambda x: 0), list_transform(range(63 - keep_context), lambda x: 1)), ',') AS type_ids, CAST(len(ids) AS BIGINT) AS n_mask FROM enc", _ENC),
    "corpus_diversity": _q("SELECT * REPLACE (round(mean_uses, 6) AS mean_uses) FROM div"),
    "segment_length_stats": _q("SELECT split, round(seg_len_mean, 6) AS seg_len_mean, round(seg_len_std, 6) AS seg_len_std, seg_len_min, seg_len_max FROM len"),
    "histograms": _q("SELECT split, 'segment_length' AS kind, mass AS value, count(*) AS n FROM seg GROUP BY ALL UNION ALL SELECT split, 'boundaries', n_seg - 1, count(*) FROM (SELECT DISTINCT split, dialogue_id, n_seg FROM u) GROUP BY ALL"),
    "split_overlap": _q("SELECT * FROM ov"),
    "opener_js": _q("SELECT split, round(opener_js, 6) AS opener_js FROM js"),
    "gate_checks": _q(
        "SELECT rule, split, CASE WHEN ok THEN 'OK' ELSE level END AS level, round(CAST(value AS DOUBLE), 6) AS value FROM ("
        "SELECT 'segment_length_varies' AS rule, split, 'FAIL' AS level, seg_len_std AS value, seg_len_std > 0 AS ok FROM len WHERE split = 'train'"
        " UNION ALL SELECT 'distinct_train_segments', split, 'WARN', distinct_segments, distinct_segments >= 500 FROM div WHERE split = 'train'"
        " UNION ALL SELECT 'train_reuse', split, 'WARN', max_uses, max_uses <= 5 FROM div WHERE split = 'train'"
        " UNION ALL SELECT 'closing_cue_gap', split, 'WARN', final_rate - other_rate, final_rate - other_rate <= 0.3 FROM cue WHERE split = 'train'"
        " UNION ALL SELECT 'in_session_repeats', split, 'WARN', in_session_repeats, in_session_repeats = 0 FROM div WHERE split = 'train'"
        " UNION ALL SELECT kind || '_baseline_pk', split, 'FAIL', pk, pk >= 0.2 FROM bl"
        " UNION ALL SELECT 'distinct_eval_segments', split, 'WARN', distinct_segments, distinct_segments >= 40 FROM div WHERE split <> 'train'"
        " UNION ALL SELECT 'shared_with_train', div.split, 'FAIL', coalesce(shared_segments, 0), coalesce(shared_segments, 0) = 0 FROM div LEFT JOIN ov ON least(div.split, 'train') = split_a AND greatest(div.split, 'train') = split_b WHERE div.split <> 'train'"
        " UNION ALL SELECT 'opener_js', split, 'WARN', opener_js, opener_js <= 0.3 FROM js"
        " UNION ALL SELECT 'shared_between_evals', a.split || '+' || b.split, 'FAIL', coalesce(shared_segments, 0), coalesce(shared_segments, 0) = 0 FROM div a JOIN div b ON a.split < b.split AND a.split <> 'train' AND b.split <> 'train' LEFT JOIN ov ON split_a = a.split AND split_b = b.split)"
    ),
    "split_assignment": _q("SELECT doc_id, domain, split FROM spl"),
    "gen_jobs": _q(f"SELECT job_id, split, domain, doc_id AS source_doc_id, num_turns, array_to_string(list_transform(list_sort(list_transform(facts, lambda x: md5('42|' || job_id || '|' || x) || x))[:k], lambda y: substr(y, 33)), '; ') AS facts_used, persona, opener, closing, clarify FROM job"),
    "split_counts": _q("SELECT split, count(DISTINCT doc_id) AS n_docs, count(*) AS n_jobs FROM job GROUP BY split"),
    "thin_domains": _q("SELECT domain, count(*) AS n_docs FROM doc WHERE domain NOT IN ('src0', 'src1') GROUP BY domain HAVING count(*) < 60"),
    "pending_jobs": _q("SELECT job_id FROM rep0 WHERE conv_id % 17 <> 5 OR job_id >= '500'"),
    "parse_replies": _q("SELECT job_id, parse_error, CASE WHEN parse_error IS NULL THEN CAST(json_array_length(j, '$.utterances') AS BIGINT) END AS n_utterances FROM rep3"),
    "validate_replies": _q("SELECT job_id, got, fault FROM flt"),
    "ingest_outcomes": _q("SELECT job_id, outcome FROM outc"),
    "outcome_counts": _q("SELECT outcome, count(*) AS n FROM outc GROUP BY outcome"),
    "turn_drift": _q("SELECT drift, count(*) AS n FROM outc WHERE drift IS NOT NULL GROUP BY drift"),
    "session_lines": _q("SELECT dialogue_id, string_agg(regexp_replace(text, '[\\r\\n]+', ' ', 'g') || CASE WHEN nx <> seg_rank THEN chr(10) || repeat('=', 16) ELSE '' END, chr(10) ORDER BY utt_idx) || chr(10) AS lines FROM anc0 GROUP BY dialogue_id"),
    "drop_closing": _q("SELECT dialogue_id AS session_id, CAST(sum(m) AS BIGINT) AS num_turns, string_agg(CASE WHEN seg_rank < n_seg - 1 THEN CAST(b AS VARCHAR) END, ',' ORDER BY seg_rank) AS gold_boundaries FROM (SELECT *, CAST(sum(m) OVER (PARTITION BY dialogue_id ORDER BY seg_rank) AS BIGINT) - 1 AS b FROM drp) GROUP BY dialogue_id"),
    "quartile_buckets": _q("SELECT * FROM bkt"),
    "stratified_split": _q(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {rank(repr('43'), 'dialogue_id')}) AS place FROM bkt) WHERE place <= 62"),
    "win_tie_loss": _q("SELECT metric, round(avg(base), 6) AS base, round(avg(cand), 6) AS cand, count(*) FILTER (diff < -1e-9) AS wins, count(*) FILTER (abs(diff) <= 1e-9) AS ties, count(*) FILTER (diff > 1e-9) AS losses FROM dif GROUP BY metric"),
    "paired_bootstrap": _q("SELECT metric, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_not_better FROM bt GROUP BY metric"),
    "wilcoxon": _q("SELECT metric, CAST(n AS BIGINT) AS n, round(w, 6) AS w, round(z, 6) AS z, round(least(1.0, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)), 6) AS p FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM (SELECT *, abs(z) / sqrt(2.0::DOUBLE) AS x FROM wx3))"),
    "pairwise_cosine": _q("SELECT win, i, j, same, round(cos, 6) AS cos FROM pc"),
    "mean_pool": _q("SELECT win, label, dim - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT win, label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e) GROUP BY win, label, dim"),
    "margin_loss": _q("SELECT win, count(*) AS anchors, round(avg(loss), 6) AS loss FROM ml GROUP BY win"),
    "supcon_loss": _q("SELECT win, count(*) AS anchors, round(avg(loss), 6) AS loss FROM sup GROUP BY win"),
    "topic_margin_loss": _q("SELECT batch, count(*) AS anchors, round(avg(loss), 6) AS loss FROM tm GROUP BY batch"),
    "early_stopping": _q("SELECT run, epoch, round(val_pk, 6) AS val_pk, round(best, 6) AS best, is_best, bad, coalesce(max(CASE WHEN bad >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM ep3"),
    "epoch_means": _q("SELECT run, epoch, n_steps, round(val_pk, 6) AS val_pk FROM ep0"),
    "pseudo_boundaries": _q("SELECT win AS dialogue_id, i + 1 AS start FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY depth DESC, i DESC) AS r FROM ps4) WHERE r <= 5 UNION ALL SELECT DISTINCT win, 0 FROM ps2"),
    "domain_documents": _q("SELECT doc_id, domain FROM doc WHERE domain IN ('src2', 'src5')"),
    "job_prompts": _q(
        "SELECT job_id, md5('Viết một đoạn hội thoại về ' || doc_id || ' (lĩnh vực: ' || domain || '). Công dân: ' || persona || ', tự xưng \"' || own || '\", gọi cán bộ là \"' || other || '\". Đúng ' || num_turns || ' lượt. Mở đầu: ' || opener"
        " || '. Kết thúc: ' || closing || '. Cán bộ ' || answers || CASE WHEN clarify THEN ', có một lần hỏi lại' ELSE '' END || '.' || chr(10) || array_to_string(used, chr(10))) AS prompt, own, other FROM prm"
    ),
    "addressed_dialogues": _q("SELECT 'd_' || job_id || CASE WHEN num_turns = 7 THEN '_lost' ELSE '' END AS dialogue_id, domain, CASE WHEN num_turns NOT IN (5, 7) THEN own || '|' || other END AS address FROM prm"),
    "fact_lines": _q("SELECT doc_id, 'lang: ' || lang || '; source: name: ' || domain || '; sizes: ' || coalesce(CAST(n_chars AS VARCHAR), 'null') || '; ' || coalesce(CAST(doc_id AS VARCHAR), 'null') AS facts FROM doc WHERE lang IS NOT NULL AND domain IS NOT NULL"),
    "accepted_by_split": _q("SELECT CASE conv_id % 5 WHEN 3 THEN 'val' WHEN 4 THEN 'test' ELSE 'train' END AS split, count(*) AS n_accepted FROM outc JOIN rep0 USING (job_id) WHERE outcome = 'accepted' GROUP BY ALL"),
    "suffix_pool": _q("SELECT DISTINCT 'd_' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS dialogue_id, CASE conv_id % 5 WHEN 3 THEN 'val_in' ELSE 'test_in' END AS split FROM conversations WHERE conv_id % 5 >= 3"),
    "eval_manifest": _q(f"SELECT dialogue_id, n_tokens, bucket, place, split FROM (SELECT *, CASE dialogue_id % 5 WHEN 3 THEN 'val' ELSE 'test' END AS split, row_number() OVER (PARTITION BY bucket, dialogue_id % 5 ORDER BY {rank(repr('43'), 'dialogue_id')}) AS place FROM bkt) WHERE place <= 4"),
    "oversampled_sessions": _q(f"SELECT dialogue_id, n_tokens, unnest(range((599 - place) // n + 1)) AS copy FROM (SELECT dialogue_id, n_tokens, row_number() OVER (ORDER BY {rank(repr('43'), repr('candidate'), 'dialogue_id')}) - 1 AS place, count(*) OVER () AS n FROM cnt WHERE split = 'val') WHERE place < 600"),
    "session_sizes": _q("SELECT split, n_seg AS n_segs, count(*) AS n_sessions FROM (SELECT DISTINCT split, dialogue_id, n_seg FROM u) GROUP BY ALL"),
    "documents_by_improvement": _q("SELECT dialogue_id, round(base, 6) AS base, round(cand, 6) AS cand, round(diff, 6) AS diff FROM dif WHERE metric = 'pk'"),
    "comparison_coverage": _q("SELECT count(b.dialogue_id) AS n_base, count(c.dialogue_id) AS n_candidate, count(b.dialogue_id + c.dialogue_id) AS n_shared FROM m_even b FULL JOIN m_lex c ON b.dialogue_id = c.dialogue_id"),
    "retry_jobs": _q("SELECT job_id, outcome FROM outc WHERE outcome NOT IN ('accepted', 'already_ingested')"),
    "vector_norms": _q("SELECT win, i, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM e"),
    "shuffled_batches": _q(f"SELECT dialogue_id, gap_idx, place, place // 16 AS batch FROM (SELECT dialogue_id, gap_idx, row_number() OVER (ORDER BY {rank(repr('shuffle'), 'dialogue_id', 'gap_idx')}, dialogue_id, gap_idx) - 1 AS place FROM gs)"),
    "training_loss": _q(
        "SELECT batch, n_samples, round(pair_loss, 6) AS pair_loss, round(coalesce(topic_loss, 0), 6) AS topic_loss, round(pair_loss + coalesce(topic_loss, 0), 6) AS loss FROM (SELECT a.win // 4 AS batch, count(*) AS n_samples,"
        " avg(greatest(0.0, 1.0 - (CAST(a.same AS INT) + a.cos - CAST(b.same AS INT) - b.cos))) AS pair_loss FROM pc a JOIN pc b ON a.win = b.win AND a.i = b.i AND a.j = a.i + 1 AND b.j = a.i + 2 GROUP BY ALL)"
        " LEFT JOIN (SELECT batch, avg(loss) AS topic_loss FROM tm GROUP BY batch) USING (batch)"
    ),
}
