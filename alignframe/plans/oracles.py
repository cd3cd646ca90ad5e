"""The same queries as DuckDB SQL, over the same tables."""

from __future__ import annotations

from alignframe.functions.text import PUNCTUATION
from alignframe.operators import prompts
from alignframe.plans import fixtures as fx
from alignframe.plans.queries import JUDGE_SYSTEM, JUDGE_TEMPLATE, SHORT_JUDGE_TEMPLATE


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _select(expressions: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {name}" for name, e in expressions.items()) + f" FROM {source}"


def _render(template: str, **values: str) -> str:
    out = _quote(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def _part(key: str, seed: int) -> str:
    """A fifth of all rows, those with the smallest hashes, is held out."""
    place = f"row_number() OVER (ORDER BY md5('{seed}:' || {key}))"
    return f"CASE WHEN {place} <= floor(count(*) OVER () * 0.2 + 0.5) THEN 'test' ELSE 'train' END"


def _bucket(key: str, seed: int, buckets: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % {buckets})"


def _chat(messages: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform({messages}, "
        "lambda m: '<|' || m.role || '|>' || chr(10) || m.content || chr(10)), ''), '')"
    )


_TURN = (
    "{'role': CASE WHEN starts_with(t, 'Human:') THEN 'user' ELSE 'assistant' END, 'content': "
    + _strip("regexp_replace(t, '^(Human:|Assistant:)', '')")
    + "}"
)


def _messages(x: str) -> str:
    pieces = rf"string_split(regexp_replace({x}, '(Human:|Assistant:)', chr(1) || '\1', 'g'), chr(1))"
    return (
        f"list_filter(list_transform(list_filter({pieces}, lambda t: regexp_matches(t, '^(Human:|Assistant:)')), "
        f"lambda t: {_TURN}), lambda m: m.content <> '')"
    )


def _lead(x: str) -> str:
    return _strip(rf"regexp_extract({x}, '^((?s:.*?))(?:Human:|Assistant:|$)', 1)")


def _instruction(x: str) -> str:
    several = rf"len(regexp_extract_all({x}, '\bAssistant:')) >= 2"
    return _strip(rf"CASE WHEN {several} THEN regexp_extract({x}, '^((?s:.*))\bAssistant:', 1) ELSE {x} END")


def _last_answer(x: str) -> str:
    """Pieces that end before a human line; in the last one with an answer, all that follows its first marker."""
    piece = f"list_filter(string_split({x}, chr(10) || 'Human:'), lambda s: contains(s, 'Assistant:'))[-1]"
    return f"coalesce({_strip(f"substr({piece}, instr({piece}, 'Assistant:') + 10)")}, '')"


_CTE: dict[str, str] = {
    "labelled": "SELECT * FROM documents LEFT JOIN labels USING (doc_id)",
    "pref_pairs": """SELECT a.doc_id // 2 AS pair_id, a.lang, i.text AS prompt, a.text AS response_0, b.text AS response_1,
        CASE WHEN coalesce(b.quality, 0) > coalesce(a.quality, 0) THEN 1 ELSE 0 END AS better_response_id,
        CASE WHEN coalesce(b.toxic, 0) < coalesce(a.toxic, 0) THEN 1 ELSE 0 END AS safer_response_id,
        a.toxic = 0 AS is_response_0_safe, b.toxic = 0 AS is_response_1_safe
        FROM labelled a JOIN labelled b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0
        JOIN benchmark i ON i.item_id = (a.doc_id // 2) % (SELECT count(*) FROM benchmark)""",
    "picked": """SELECT *, CASE better_response_id WHEN 0 THEN response_0 ELSE response_1 END AS chosen,
        CASE better_response_id WHEN 0 THEN response_1 ELSE response_0 END AS rejected FROM pref_pairs""",
    "agreed": """SELECT * FROM picked WHERE better_response_id = safer_response_id
        AND coalesce(CASE better_response_id WHEN 0 THEN is_response_0_safe ELSE is_response_1_safe END, false)""",
    "summaries": """SELECT doc_id, l.text AS document, i.text AS claim,
        CASE WHEN quality = 1 THEN 'faithful' ELSE 'unfaithful' END AS label FROM labelled l
        JOIN benchmark i ON i.item_id = l.doc_id % (SELECT count(*) FROM benchmark)""",
    "claim_prompts": f"SELECT *, {_render(prompts.CLAIM_TO_FORMULA, claim='claim')} AS prompt FROM summaries",
    "spoken": """SELECT conv_id, max(turn) FILTER (role <> 'system') AS last_turn FROM conversations GROUP BY conv_id""",
    "answers": """SELECT conv_id - 1 AS conv_id, arg_max(text, turn) AS answer FROM conversations
        WHERE role = 'assistant' GROUP BY conv_id""",
    "transcripts": """SELECT c.conv_id, ['harmless', 'helpful', 'online', 'sampled'][1 + c.conv_id % 4] AS subset,
        CASE WHEN c.conv_id % 8 = 1 THEN coalesce(arg_min(c.text, c.turn) FILTER (role = 'system'), '') ELSE '' END
            || coalesce(string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' ELSE
            chr(10) || chr(10) || 'Assistant: ' END || c.text, '' ORDER BY turn) FILTER (role <> 'system'), '') AS chosen,
        CASE WHEN c.conv_id % 8 = 1 THEN coalesce(arg_min(c.text, c.turn) FILTER (role = 'system'), '') ELSE '' END
            || coalesce(string_agg(CASE role WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' ELSE
            chr(10) || chr(10) || 'Assistant: ' END || c.text, '' ORDER BY turn)
            FILTER (role <> 'system' AND turn < last_turn), '')
            || chr(10) || chr(10) || 'Assistant: ' || coalesce(any_value(answer), 'No.') AS rejected
        FROM conversations c JOIN spoken USING (conv_id) LEFT JOIN answers USING (conv_id) GROUP BY c.conv_id""",
    "parsed": f"""SELECT *, {_messages('chosen')} AS mc, {_messages('rejected')} AS mr, {_lead('chosen')} AS lc,
        {_lead('rejected')} AS lr FROM transcripts""",
    "bitext": """SELECT a.doc_id // 2 AS pair_id, a.text AS src, b.text AS ref
        FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 AND a.doc_id % 2 = 0""",
    "rollouts": _select(fx.ROLLOUTS, "lineitem"),
    "combined": """SELECT *, CASE WHEN isnan(reward_a) THEN 0 ELSE reward_a END
        + 5 * CASE WHEN isnan(reward_b) THEN 0 ELSE reward_b END AS reward FROM rollouts""",
    "completions": "SELECT l_orderkey AS prompt_id, l_partkey AS part_id, l_linenumber AS line_no, ["
    + ", ".join(f"(l_partkey * {i + 3} + l_suppkey) % 17" for i in range(12))
    + "] AS ids FROM lineitem",
    "masked": """SELECT *, list_position(ids, 0) AS ended_at, list_position(ids, 0) IS NOT NULL
        AND list_position(ids, 0) > 0 AS terminated FROM completions""",
    "measured": "SELECT *, CASE WHEN terminated THEN ended_at ELSE len(ids) END AS length FROM masked",
    "token_stats": _select(fx.TOKEN_STATS, "lineitem"),
    "verdicts": _select(fx.VERDICTS, "orders"),
    "answered": f"SELECT * FROM ({_select(fx.VERDICTS, 'orders')}) WHERE idx % 50 <> 0",
    "judged": _select(fx.JUDGED, "orders WHERE o_orderkey % 2 = 0"),
    "read": """SELECT *, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.better_answer') END AS output
        FROM verdicts""",
    "read_answered": """SELECT *, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.better_answer') END AS output
        FROM answered""",
    "board_answered": """SELECT idx, sum(CASE WHEN output = target THEN 1 WHEN output IN ('A', 'B') THEN -1 ELSE 0 END)::BIGINT
        AS net FROM read_answered WHERE output IS NOT NULL GROUP BY idx""",
    "outcomes_answered": """SELECT idx, net, CASE WHEN net > 0 THEN 'win' WHEN net < 0 THEN 'lost' ELSE 'tie' END AS outcome
        FROM board_answered""",
    "board": """SELECT idx, sum(CASE WHEN output = target THEN 1 WHEN output IN ('A', 'B') THEN -1 ELSE 0 END)::BIGINT
        AS net FROM read WHERE output IS NOT NULL GROUP BY idx""",
    "outcomes": """SELECT idx, net, CASE WHEN net > 0 THEN 'win' WHEN net < 0 THEN 'lost' ELSE 'tie' END AS outcome
        FROM board""",
    "formula_pairs": f"{_select(fx.FORMULA_PAIRS, '(' + _select(fx.FORMULA_BODIES, 'part') + ')')}",
}

# The same alphabet and shapes as the library's, written down on their own.
SYMBOLS = "⊕∨∧→↔∀∃¬(),"
_NAME = r"[^⊕∨∧→↔∀∃¬(),\s]+"
_LITERAL = r"[^⊕∨∧→↔∀∃¬(),\s]+ \( [^⊕∨∧→↔∀∃¬(),\s]+(?: , [^⊕∨∧→↔∀∃¬(),\s]+)* \)"

# Formula tokens: pad the symbols, then bracket words of two or more characters and let adjoining brackets vanish.
_PADDED = rf"regexp_replace({{0}}, '([{SYMBOLS}])', ' \1 ', 'g')"
_RAW = rf"list_filter(list_transform(string_split_regex({_PADDED}, '\s+'), lambda t: replace(t, '''', '')), lambda t: t <> '')"
_MERGED = (
    f"translate(replace(array_to_string(list_transform({_RAW}, lambda t: CASE WHEN length(t) > 1 "
    "THEN chr(1) || upper(t[1]) || t[2:] || chr(2) ELSE t END), ' '), chr(2) || ' ' || chr(1), ''), "
    "chr(1) || chr(2), '')"
)
_MATRIX = rf"regexp_replace({_MERGED} || ' ', '[∀∃] {_NAME} ', '', 'g')"
_LITERALS = (
    f"list_transform(regexp_extract_all({_MATRIX}, '({_LITERAL})', 1), lambda t: replace(t, ' ', ''))"
)


def _distinct_literals(x: str) -> str:
    found = _LITERALS.format(x)
    return f"(SELECT list(l ORDER BY p) FROM (SELECT l, min(p) AS p FROM (SELECT unnest({found}) AS l, unnest(range(len({found}))) AS p) GROUP BY l))"


def _literal_rows(column: str) -> str:
    found = _LITERALS.format(column)
    return f"""SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY min(p)) - 1 AS pos, literal
        FROM (SELECT pair_id, unnest({found}) AS literal, unnest(range(len({found}))) AS p FROM formula_pairs)
        GROUP BY pair_id, literal"""


_CTE |= {
    "pred_lits": _literal_rows("pred"),
    "gold_lits": _literal_rows("gold"),
    "vectors": f"""SELECT literal, embedding FROM (SELECT DISTINCT literal FROM (
        SELECT literal FROM pred_lits UNION ALL SELECT literal FROM gold_lits)) l
        JOIN embeddings e ON e.vec_id = {_bucket('literal', 0, 1 << 32)} % (SELECT count(*) FROM embeddings)""",
    "similarity": """SELECT pair_id, g.literal AS gold, g.pos AS gold_pos, p.literal AS pred, p.pos AS pred_pos,
        list_cosine_similarity(vg.embedding::DOUBLE[], vp.embedding::DOUBLE[]) AS similarity
        FROM gold_lits g JOIN pred_lits p USING (pair_id)
        JOIN vectors vg ON vg.literal = g.literal JOIN vectors vp ON vp.literal = p.literal""",
}


# Tables that others read more than once and that are costly to make.
_READ_OFTEN = {"formula_pairs", "pred_lits", "gold_lits", "vectors", "similarity", "best", "bindings"}


def _with(names: str, body: str) -> str:
    kept = lambda n: " MATERIALIZED" if n in _READ_OFTEN else ""
    return "WITH " + ", ".join(f"{n} AS{kept(n)} ({_CTE[n]})" for n in names.split()) + " " + body


def _bleu_counts(source: str, keys: str) -> str:
    """CTEs from a table with ``keys, hyp, ref`` (token lists) to counts per key and order."""
    grams = lambda side: (
        f"SELECT {keys}, n, array_to_string({side}[i:i + n - 1], chr(1)) AS g, count(*) AS c FROM "
        f"(SELECT {keys}, {side}, n, unnest(range(1, len({side}) - n + 2)) AS i FROM "
        f"(SELECT {keys}, {side}, unnest([1, 2, 3, 4]) AS n FROM {source})) GROUP BY ALL"
    )
    return f"""hg AS ({grams('hyp')}), rg AS ({grams('ref')}),
        matched AS (SELECT {keys}, n, sum(least(hg.c, rg.c)) AS m FROM hg JOIN rg USING ({keys}, n, g) GROUP BY ALL),
        counts AS (SELECT {keys}, n, greatest(len(hyp) - n + 1, 0) AS t, coalesce(m, 0) AS m, len(hyp) AS h, len(ref) AS r
            FROM (SELECT *, unnest([1, 2, 3, 4]) AS n FROM {source}) LEFT JOIN matched USING ({keys}, n))"""


def _bleu_score(source: str, keys: str) -> str:
    """One score per key from summed counts ``keys, n, t, m, h, r``."""
    return f"""SELECT {keys}, CASE WHEN sum(m) = 0 THEN 0.0 ELSE
            CASE WHEN max(h) >= max(r) THEN 1.0 ELSE exp(1 - max(r) / max(h)) END
            * exp(avg(ln(CASE WHEN m > 0 THEN m / t ELSE 1 / (pow(2, zeros) * t) END) ) FILTER (t > 0)) END AS bleu
        FROM (SELECT *, sum(CASE WHEN m = 0 AND t > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY n) AS zeros
            FROM {source}) GROUP BY {keys}"""


_CTE |= {
    "token_pairs": f"""SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'forward' ELSE 'backward' END AS direction,
        pair_id // 16 AS batch_id, {_words('src')} AS hyp, {_words('ref')} AS ref FROM bitext""",
}
def _set_apart(x: str) -> str:
    for pattern, put in PUNCTUATION:
        x = f"regexp_replace({x}, '{pattern}', '{put.replace('$', chr(92))}', 'g')"
    return x


_TRANSLATION_TOKENS = _CTE["token_pairs"].replace(_words("src"), _words(_set_apart("src"))).replace(
    _words("ref"), _words(_set_apart("ref"))
)
_BLEU = f"{_bleu_counts('token_pairs', 'pair_id')}, scored AS ({_bleu_score('counts', 'pair_id')})"
_TOKENS_WITH = f"WITH bitext AS ({_CTE['bitext']}), token_pairs AS ({_CTE['token_pairs']}), "
_SUMS = "SELECT {0}, n, sum(t) AS t, sum(m) AS m, sum(h) AS h, sum(r) AS r, count(*) AS rows FROM counts JOIN token_pairs USING (pair_id) GROUP BY ALL"

ORACLES: dict[str, str] = {
    "a1_read_parquet_set": "SELECT * FROM labels",
    "a2_read_json_records": _with("labelled summaries", "SELECT doc_id, claim, label FROM summaries"),
    "a3_read_subsets": """SELECT subset, lang, count(*) AS rows, sum(n_chars)::BIGINT AS chars FROM documents JOIN
        (VALUES (0, 'helpful-base'), (1, 'helpful-online'), (2, 'helpful-rejection-sampled'), (3, 'harmless-base')) s(k, subset)
        ON doc_id % 4 = k GROUP BY ALL""",
    "a4_append_unscored": _with("labelled summaries", "SELECT doc_id, claim FROM summaries WHERE doc_id % 4 > 1"),
    "a5_metric_rows": """SELECT 'run-1' AS run, l_returnflag AS subset, metric, round(value, 6) AS value FROM (
        SELECT l_returnflag, avg(l_discount) AS "reward/mean", max(l_discount) AS "reward/max", count(*)::DOUBLE AS rows
        FROM lineitem GROUP BY 1) UNPIVOT (value FOR metric IN ("reward/mean", "reward/max", rows))""",
    "b1_agreed_safe": _with("labelled pref_pairs picked agreed", "SELECT pair_id, better_response_id, lang FROM agreed"),
    "b2_label_is": _with("labelled summaries", "SELECT doc_id, label FROM summaries WHERE label = 'faithful'"),
    "b3_length_between": _with(
        "labelled summaries",
        """SELECT doc_id, length(document)::BIGINT AS chars FROM summaries WHERE length(document) BETWEEN 200 AND 8096
        AND length(claim) <= 200 AND NOT contains(document, 'license') AND NOT contains(document, 'eau')""",
    ),
    "b4_nonempty": _with(
        "spoken answers transcripts",
        f"""SELECT conv_id, length(target)::BIGINT AS chars FROM (SELECT conv_id,
        CASE WHEN contains(chosen, 'Assistant:') THEN {_strip("string_split(chosen, 'Assistant:')[-1]")} ELSE '' END
        AS target FROM transcripts) WHERE target <> ''""",
    ),
    "b5_check_required": _with(
        "labelled pref_pairs",
        """SELECT count(*) AS rows, count(*) FILTER (coalesce(prompt, '') = '') AS missing_prompt,
        count(*) FILTER (coalesce(response_0, '') = '') AS missing_response_0,
        count(*) FILTER (is_response_0_safe IS NULL) AS missing_is_response_0_safe FROM pref_pairs""",
    ),
    "b6_within_formula_budget": _with(
        "formula_pairs",
        """SELECT pair_id, length(pred) <= 180 AND len(regexp_extract_all(pred, '∧')) <= 5
        AND len(regexp_extract_all(pred, '∨')) <= 5 AS in_budget FROM formula_pairs""",
    ),
    "c1_render_prompt": _with(
        "labelled summaries",
        f"""SELECT doc_id, {_render(prompts.CLAIM_TO_FORMULA, claim='claim')} AS claim_prompt,
        md5({_render(prompts.PASSAGE_TO_FORMULA, document='document')}) AS document_prompt FROM summaries""",
    ),
    "c2_pick_preferred": _with(
        "labelled pref_pairs picked", "SELECT pair_id, md5(chosen) AS chosen, md5(rejected) AS rejected FROM picked"
    ),
    "c3_render_chat": _with(
        "spoken answers transcripts parsed",
        f"""SELECT conv_id, {_chat("CASE WHEN mc[-1].role = 'assistant' THEN mc[:-2] ELSE mc END")}
        || '<|assistant|>' || chr(10) AS prompt FROM parsed""",
    ),
    "c4_strip_known_suffix": _with(
        "spoken answers transcripts",
        f"""SELECT conv_id, substr(chosen, 1, length(chosen) - length({_last_answer('chosen')})) AS instruction
        FROM transcripts""",
    ),
    "d1_parse_transcript": _with(
        "spoken answers transcripts parsed",
        f"""SELECT conv_id, lc <> '' OR len(mc) = 0 AS malformed,
        len(CASE WHEN mc[-1].role = 'assistant' THEN mc[:-2] ELSE mc END)::BIGINT AS n,
        {_chat("CASE WHEN mc[-1].role = 'assistant' THEN mc[:-2] ELSE mc END")} AS chat FROM parsed""",
    ),
    "d2_split_last_turn": _with(
        "spoken answers transcripts",
        f"""SELECT conv_id, CASE WHEN contains(chosen, 'Assistant:') THEN
        {_strip("array_to_string(string_split(chosen, 'Assistant:')[:-2], 'Assistant:')")}
        ELSE {_strip('chosen')} END AS instruction,
        CASE WHEN contains(chosen, 'Assistant:') THEN {_strip("string_split(chosen, 'Assistant:')[-1]")} ELSE '' END
        AS target FROM transcripts""",
    ),
    "d3_extract_instruction": _with(
        "spoken answers transcripts", f"SELECT conv_id, {_instruction('chosen')} AS instruction FROM transcripts"
    ),
    "d4_extract_last_answer": _with(
        "spoken answers transcripts", f"SELECT conv_id, {_last_answer('rejected')} AS answer FROM transcripts"
    ),
    "d5_preference_triples": _with(
        "spoken answers transcripts",
        f"""SELECT conv_id, {_instruction('chosen')} AS prompt, {_last_answer('chosen')} AS chosen,
        {_last_answer('rejected')} AS rejected FROM transcripts""",
    ),
    "d6_paired_messages": _with(
        "spoken answers transcripts parsed",
        f"""SELECT conv_id, lc <> '' OR len(mc) = 0 OR lr <> '' OR len(mr) = 0 AS malformed,
        {_chat('mc[:-2]')} AS message_instruction, {_chat('mc')} AS message_chosen, {_chat('mr')} AS message_rejected
        FROM parsed""",
    ),
    "d6_label_pairs": _with(
        "spoken answers transcripts parsed",
        f"""SELECT conv_id, lc <> '' OR len(mc) = 0 AS malformed, {_chat('mc[:-2]')} || '<|assistant|>' || chr(10)
        AS prompt, mc[-1].content AS better_answer FROM parsed""",
    ),
    "e1_supervised_examples": _with(
        "labelled summaries claim_prompts",
        "",
    ).rstrip()
    + f""", texts AS (SELECT doc_id, {_words('prompt')} AS p, {_words('document')} AS a FROM claim_prompts),
        vocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS id
            FROM (SELECT unnest(p || a) AS token FROM texts) GROUP BY token),
        placed AS (SELECT doc_id, unnest(p || a) AS token, unnest(range(len(p || a))) AS pos FROM texts),
        coded AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM placed JOIN vocab USING (token) GROUP BY doc_id),
        whole AS (SELECT doc_id, len(p) AS np, CASE WHEN len(ids) < 4096 THEN ids || [0] ELSE ids END AS ids
            FROM coded JOIN texts USING (doc_id))
        SELECT doc_id, array_to_string(ids, ',') AS input_ids, array_to_string(
            list_transform(range(len(ids)), lambda i: CASE WHEN i < np THEN -100 ELSE ids[i + 1] END), ',') AS labels,
            len(ids)::BIGINT AS n FROM whole""",
    "i5_group_advantages_missing": _with(
        "rollouts",
        """SELECT prompt_id, part_id, supp_id, line_no, round((v - m) / (s + 1e-4), 6) + 0.0::DOUBLE AS advantage, abs(s) <= 1e-8 AS zero_std
        FROM (SELECT *, avg(v) OVER g AS m, coalesce(stddev_samp(v) OVER g, 0) AS s FROM (
            SELECT *, CASE WHEN isnan(reward_b) THEN NULL ELSE reward_b END AS v FROM rollouts)
        WINDOW g AS (PARTITION BY prompt_id))""",
    ),
    "i9_minmax_scale_missing": _with(
        "rollouts",
        """SELECT prompt_id, part_id, supp_id, line_no,
        round(CASE WHEN v IS NULL THEN NULL WHEN gl = gh THEN 0 ELSE (v - gl) / (gh - gl) END, 6) AS in_group,
        round(CASE WHEN v IS NULL THEN NULL WHEN tl = th THEN 0 ELSE (v - tl) / (th - tl) END, 6) AS in_table
        FROM (SELECT *, min(v) OVER (PARTITION BY prompt_id) AS gl, max(v) OVER (PARTITION BY prompt_id) AS gh,
        min(v) OVER () AS tl, max(v) OVER () AS th FROM (
            SELECT *, CASE WHEN isnan(reward_b) THEN NULL ELSE reward_b END AS v FROM rollouts))""",
    ),
    "e2_split_by_key": f"""SELECT doc_id, {_part('doc_id', 0)}
        AS part FROM documents""",
    "e3_seeded_order": """SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1
        AS position FROM orders""",
    "e3_length_order": "SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) - 1 AS position FROM documents",
    "e4_padding_report": """SELECT batch_id, count(*) AS rows, max(chars) AS max_len,
        (ceil(max(chars) / 8) * 8)::BIGINT AS padded_len,
        ((ceil(max(chars) / 8) * 8) * count(*) - sum(chars))::BIGINT AS waste FROM (
        SELECT length(text)::BIGINT AS chars, (row_number() OVER (ORDER BY length(text)) - 1) // 16 AS batch_id
        FROM documents) GROUP BY batch_id""",
    "e5_preview": _with(
        "labelled summaries claim_prompts", "SELECT doc_id, prompt FROM claim_prompts ORDER BY doc_id LIMIT 3"
    ),
    "f1_bidirectional": _with(
        "bitext",
        f"""SELECT pair_id, direction, seq, md5(prompt) AS prompt, md5(target) AS ref FROM (
        SELECT pair_id, 'forward' AS direction, 2 * r AS seq, {_render(prompts.ENGLISH_TO_GERMAN, src='src')} AS prompt,
            ref AS target FROM (SELECT *, row_number() OVER (ORDER BY length(src), pair_id) - 1 AS r FROM bitext)
        UNION ALL SELECT pair_id, 'backward', 2 * r + 1, {_render(prompts.GERMAN_TO_ENGLISH, src='ref')}, src
            FROM (SELECT *, row_number() OVER (ORDER BY length(src), pair_id) - 1 AS r FROM bitext))""",
    ),
    "f2_by_direction": _TOKENS_WITH + _BLEU + """ SELECT direction, count(*) AS rows, round(avg(bleu), 6) AS bleu,
        round(max(bleu), 6) AS best, sum(len(hyp))::BIGINT AS tokens FROM token_pairs JOIN scored USING (pair_id)
        GROUP BY direction""",
    "f2_translation_evaluation": f"WITH bitext AS ({_CTE['bitext']}), token_pairs AS ({_TRANSLATION_TOKENS}), "
    + _bleu_counts("token_pairs", "pair_id")
    + f""", sums AS ({_SUMS.format('direction, batch_id')}),
        overlap AS (SELECT s.*, t > 0 AS long FROM ({_bleu_score('sums', 'direction, batch_id')}) s
            JOIN (SELECT direction, batch_id, min(t) AS t FROM sums GROUP BY ALL) USING (direction, batch_id)),
        weighted AS (SELECT direction, sum(rows)::BIGINT AS rows,
            round(sum(CASE WHEN long THEN bleu ELSE 0 END * rows) / sum(rows), 6) AS bleu FROM overlap
            JOIN (SELECT direction, batch_id, max(rows) AS rows FROM sums GROUP BY ALL) USING (direction, batch_id)
            GROUP BY direction)
        SELECT direction, rows, bleu, quality FROM weighted JOIN (SELECT direction, round(avg((pair_id % 10) / 10), 6) AS quality
            FROM token_pairs GROUP BY direction) USING (direction)""",
    "m1_translation_reward": _TOKENS_WITH
    + _BLEU
    + " SELECT pair_id, round(bleu * 0.5 + (pair_id % 10) / 10 * 0.5, 6) AS reward FROM scored",
    "g1_sentence_bleu": _TOKENS_WITH + _BLEU + " SELECT pair_id, round(bleu, 6) AS bleu FROM scored",
    "g2_corpus_bleu": _TOKENS_WITH
    + _bleu_counts("token_pairs", "pair_id")
    + f""", sums AS ({_SUMS.format('direction')}) SELECT direction, rows, round(bleu, 6) AS bleu
        FROM ({_bleu_score('sums', 'direction')}) JOIN (SELECT direction, max(rows) AS rows FROM sums GROUP BY 1)
        USING (direction)""",
    "g3_batch_weighted_bleu": _TOKENS_WITH
    + _bleu_counts("token_pairs", "pair_id")
    + f""", sums AS ({_SUMS.format('direction, batch_id')}) SELECT direction, sum(rows)::BIGINT AS rows,
        round(sum(bleu * rows) / sum(rows), 6) AS bleu FROM ({_bleu_score('sums', 'direction, batch_id')})
        JOIN (SELECT direction, batch_id, max(rows) AS rows FROM sums GROUP BY ALL) USING (direction, batch_id)
        GROUP BY direction""",
    "g4_blend_scores": _TOKENS_WITH
    + _BLEU
    + " SELECT pair_id, round(bleu * 0.5 + (pair_id % 10) / 10 * 0.5, 6) AS score FROM scored",
    "h1_formula_tokens": _with(
        "formula_pairs",
        f"""SELECT pair_id, {_MERGED.format('pred')} AS tokens, array_to_string(list_transform(r, lambda t, i:
            CASE WHEN t IN ('⊕', '∨', '∧', '→', '↔') THEN ' ' || t || ' ' WHEN t = ',' THEN ', '
            WHEN regexp_matches(t, '^\\w$') AND i > 1 AND coalesce(r[i - 1] IN ('∀', '∃'), false) THEN t || ' '
            ELSE t END), '') AS normalized
        FROM (SELECT *, {_RAW.format('pred')} AS r FROM formula_pairs)""",
    ),
    "h2_hoist_quantifiers": _with(
        "formula_pairs",
        r"""SELECT pair_id, list_reduce(list_reverse(regexp_extract_all(mixed, '[∃∀]\w')), lambda acc, m: m || ' '
        || substr(acc, 1, instr(acc, m) - 1) || substr(acc, instr(acc, m) + length(m)), mixed) AS hoisted
        FROM (SELECT pair_id, pred || ' → ' || gold AS mixed FROM formula_pairs)""",
    ),
    "h3_formula_literals": _with("formula_pairs pred_lits", "SELECT pair_id, pos, literal FROM pred_lits"),
    "h4_literal_similarity": _with(
        "formula_pairs pred_lits gold_lits vectors similarity",
        "SELECT pair_id, gold, pred, round(similarity, 6) AS similarity FROM similarity",
    ),
    "h4_literal_similarity_edit": _with(
        "formula_pairs pred_lits gold_lits",
        """SELECT pair_id, g.literal AS gold, p.literal AS pred, round(1 - levenshtein(g.literal, p.literal)
        / greatest(length(g.literal), length(p.literal)), 6) AS similarity
        FROM gold_lits g JOIN pred_lits p USING (pair_id)""",
    ),
    "h5_best_literal_match": _with(
        "formula_pairs pred_lits gold_lits vectors similarity",
        """SELECT pair_id, gold, pred FROM similarity QUALIFY row_number() OVER (PARTITION BY pair_id, gold_pos
        ORDER BY greatest(similarity, 0) DESC, pred_pos) = 1""",
    ),
    "i1_dedupe_references": """SELECT l_orderkey AS prompt_id, l_partkey AS part_id FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""",
    "i1_drop_consecutive": """SELECT o_orderkey, o_orderstatus FROM orders
        QUALIFY o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER (ORDER BY o_orderkey)""",
    "i2_attach_references": _with(
        "rollouts",
        """SELECT prompt_id, part_id, supp_id, line_no, o_orderpriority AS reference FROM rollouts
        LEFT JOIN orders ON o_orderkey = prompt_id""",
    ),
    "i2_unmatched_references": _with(
        "rollouts",
        """SELECT count(*) AS rollouts, count(*) FILTER (o_orderkey IS NULL) AS unmatched FROM rollouts
        LEFT JOIN orders ON o_orderkey = prompt_id AND o_orderkey % 3 <> 0""",
    ),
    "i3_first_per_group": _with(
        "rollouts",
        """SELECT prompt_id, line_no, part_id, supp_id FROM rollouts
        QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY line_no, part_id, supp_id) = 1""",
    ),
    "i4_combine_rewards": _with(
        "rollouts combined",
        "SELECT prompt_id, part_id, supp_id, line_no, round(reward, 6) AS reward FROM combined",
    ),
    "i5_group_advantages": _with(
        "rollouts combined",
        """SELECT prompt_id, part_id, supp_id, line_no, round((reward - m) / (s + 1e-4), 6) AS advantage,
        abs(s) <= 1e-8 AS zero_std FROM (SELECT *, avg(reward) OVER g AS m, coalesce(stddev_samp(reward) OVER g, 0) AS s
        FROM combined WINDOW g AS (PARTITION BY prompt_id))""",
    ),
    "i6_reward_report": _with(
        "rollouts combined",
        """, g AS (SELECT prompt_id, count(*) AS n, coalesce(stddev_samp(reward), 0) AS s FROM combined GROUP BY 1),
        wide AS (SELECT avg(reward_a) AS "rewards/reward_a/mean", stddev_samp(reward_a) AS "rewards/reward_a/std",
            avg(reward_b) FILTER (NOT isnan(reward_b)) AS "rewards/reward_b/mean",
            stddev_samp(reward_b) FILTER (NOT isnan(reward_b)) AS "rewards/reward_b/std", avg(reward) AS reward,
            (SELECT sum(n * s) / sum(n) FROM g) AS reward_std,
            (SELECT avg(CASE WHEN s <= 1e-8 THEN 1.0 ELSE 0.0 END) FROM g) AS frac_reward_zero_std FROM combined)
        SELECT metric, round(value, 6) AS value FROM wide UNPIVOT (value FOR metric IN ("rewards/reward_a/mean",
        "rewards/reward_a/std", "rewards/reward_b/mean", "rewards/reward_b/std", reward, reward_std,
        frac_reward_zero_std))""",
    ).replace(") , g AS", "), g AS"),
    "i7_completion_mask": _with(
        "completions masked measured",
        """SELECT prompt_id, part_id, line_no, array_to_string(ids[1:length], ',') AS kept_ids, length::BIGINT AS length,
        terminated, CASE WHEN terminated THEN length ELSE 0 END::BIGINT AS mask_sum FROM measured""",
    ),
    "i8_completion_report": _with(
        "completions masked measured",
        """SELECT round(avg(length), 6) AS mean_length, min(length)::BIGINT AS min_length, max(length)::BIGINT AS max_length,
        round(1 - count(*) FILTER (terminated) / count(*), 6) AS clipped_ratio,
        round(coalesce(avg(length) FILTER (terminated), 0), 6) AS mean_terminated_length,
        coalesce(min(length) FILTER (terminated), 0)::BIGINT AS min_terminated_length,
        coalesce(max(length) FILTER (terminated), 0)::BIGINT AS max_terminated_length FROM measured""",
    ),
    "i9_minmax_scale": _with(
        "rollouts",
        """SELECT prompt_id, part_id, supp_id, line_no,
        round(CASE WHEN gl = gh THEN 0 ELSE (reward_a - gl) / (gh - gl) END, 6) AS in_group,
        round(CASE WHEN tl = th THEN 0 ELSE (reward_a - tl) / (th - tl) END, 6) AS in_table
        FROM (SELECT *, min(reward_a) OVER (PARTITION BY prompt_id) AS gl, max(reward_a) OVER (PARTITION BY prompt_id) AS gh,
        min(reward_a) OVER () AS tl, max(reward_a) OVER () AS th FROM rollouts)""",
    ),
    "i10_tokens_seen": _with(
        "completions masked measured",
        """SELECT prompt_id // 16 AS step, sum(length)::BIGINT AS tokens,
        (sum(sum(length)) OVER (ORDER BY prompt_id // 16))::BIGINT AS num_tokens FROM measured GROUP BY prompt_id // 16""",
    ),
    "m1_apply_rewards": _with(
        "rollouts",
        """SELECT prompt_id, part_id, supp_id, line_no, round(reward_a / 2, 6) AS discount,
        round(reward_a / 2 + 2 * CASE WHEN isnan(reward_b) THEN 0 ELSE reward_b END, 6) AS reward FROM rollouts""",
    ),
}

_KL = "exp(ref_logp - logp) - (ref_logp - logp) - 1"
_MASKED = "sum({0} * mask) / greatest(sum(mask), 1)".format
_CLIP = "least(greatest({0}, {1}), {2})".format
_LOSS = (
    f"(-least(exp(logp - old_logp) * advantage, {_CLIP('exp(logp - old_logp)', 0.8, 1.2)} * advantage) + 0.12 * ({_KL}))"
)
_SEQ = f"SELECT batch_id, seq_id, sum({_LOSS} * mask) AS l, sum(mask) AS t FROM token_stats GROUP BY ALL"
_TOKEN = "seq_id, pos, part_id"

ORACLES |= {
    "j1_token_kl": _with("token_stats", f"SELECT {_TOKEN}, round({_KL}, 6) AS kl FROM token_stats"),
    "j1_mean_kl": _with(
        "token_stats", f"SELECT batch_id, round({_MASKED('(' + _KL + ')')}, 6) AS kl FROM token_stats GROUP BY batch_id"
    ),
    "j2_importance_ratio": _with(
        "token_stats",
        f"""SELECT {_TOKEN}, round(least(exp(logp - old_logp), 1.3), 6) AS ratio,
        round({_CLIP('exp(logp - old_logp)', 0.8, 1.2)}, 6) AS clipped_ratio FROM token_stats""",
    ),
    "j2_importance_ratio_sequence": _with(
        "token_stats",
        f"""SELECT {_TOKEN}, round(exp(sum((logp - old_logp) * mask) OVER s / greatest(sum(mask) OVER s, 1)), 6) AS ratio
        FROM token_stats WINDOW s AS (PARTITION BY seq_id)""",
    ),
    "j3_clipped_objective_grpo": _with(
        "token_stats",
        f"SELECT batch_id, round(avg(l / greatest(t, 1)), 6) AS loss FROM ({_SEQ}) GROUP BY batch_id",
    ),
    "j3_clipped_objective_bnpo": _with(
        "token_stats",
        f"SELECT batch_id, round(sum(l) / greatest(sum(t), 1), 6) AS loss FROM ({_SEQ}) GROUP BY batch_id",
    ),
    "j3_clipped_objective_dr_grpo": _with(
        "token_stats",
        f"SELECT batch_id, round(sum(l) / (count(*) * 512), 6) AS loss FROM ({_SEQ}) GROUP BY batch_id",
    ),
    "j4_high_entropy_mask": _with(
        "token_stats",
        f"""SELECT {_TOKEN}, mask = 1 AND entropy >= cut AS high_entropy FROM token_stats JOIN (SELECT batch_id,
        quantile_cont(entropy, 0.8) AS cut FROM token_stats WHERE mask = 1 GROUP BY batch_id) USING (batch_id)""",
    ),
    "j4_mean_entropy": _with(
        "token_stats",
        f"SELECT batch_id, round({_MASKED('entropy')}, 6) AS entropy FROM token_stats GROUP BY batch_id",
    ),
    "j5_clip_report": _with(
        "token_stats",
        f""", m AS (SELECT batch_id, mask, exp(logp - old_logp) < 0.98 AND advantage < 0 AS lo,
            exp(logp - old_logp) > 1.03 AND advantage > 0 AS hi FROM token_stats),
        b AS (SELECT batch_id, {_MASKED('lo::INT')} AS lo, {_MASKED('hi::INT')} AS hi, {_MASKED('(lo OR hi)::INT')} AS re
            FROM m GROUP BY batch_id)
        SELECT round(avg(lo), 6) AS low_mean, round(min(lo), 6) AS low_min, round(avg(hi), 6) AS high_mean,
            round(max(hi), 6) AS high_max, round(avg(re), 6) AS region_mean FROM b""",
    ).replace(") , m AS", "), m AS"),
    "j6_anchored_objective": _with(
        "token_stats",
        f""", base AS (SELECT batch_id, avg(l / greatest(t, 1)) AS loss FROM ({_SEQ}) GROUP BY batch_id),
        anchor AS (SELECT batch_id, {_MASKED(_CLIP('logp - (ref_logp - 0.5)', 0.8, 1.2))} AS a FROM token_stats
            GROUP BY batch_id)
        SELECT batch_id, round(loss - coalesce(a, 0) / 8, 6) AS loss, round(-coalesce(a, 0), 6) AS loss_corrected
        FROM base LEFT JOIN anchor USING (batch_id)""",
    ).replace(") , base AS", "), base AS"),
    "k1_judge_requests": _with(
        "labelled pref_pairs picked",
        "SELECT pair_id AS idx, target, style, md5(message) AS message FROM ("
        + " UNION ALL ".join(
            f"SELECT pair_id, '{target}' AS target, '{style}' AS style, {message} AS message FROM picked"
            for style, template, names in (
                ("long", JUDGE_TEMPLATE, ("question", "answer_a", "answer_b")),
                ("short", SHORT_JUDGE_TEMPLATE, ("input", "output_1", "output_2")),
            )
            for target, sides in (("A", ("chosen", "rejected")), ("B", ("rejected", "chosen")))
            for message in [_render(template, **dict(zip(names, ("prompt", *sides))))]
        )
        + ")",
    ),
    "k2_parse_verdicts": _with(
        "verdicts read",
        r"""SELECT idx, target, output, nullif(upper(regexp_extract(short_raw, '\(([abc])\)', 1)), '') AS short_output
        FROM read""",
    ),
    "k3_pair_scoreboard": _with("verdicts read board outcomes", "SELECT idx, net, outcome FROM outcomes"),
    "k4_win_rates": _with(
        "answered judged read_answered board_answered outcomes_answered",
        """SELECT subset, round(count(*) FILTER (outcome = 'win') / count(*), 6) AS win,
        round(count(*) FILTER (outcome = 'lost') / count(*), 6) AS lost,
        round(count(*) FILTER (outcome = 'tie') / count(*), 6) AS tie, count(*) AS total,
        count(*) FILTER (outcome IS NULL) AS invalid FROM judged LEFT JOIN outcomes_answered USING (idx) GROUP BY subset""",
    ),
    "k1_judge_chat": _with(
        "labelled pref_pairs picked",
        "SELECT pair_id AS idx, target, md5(" + _quote(f"<|system|>\n{JUDGE_SYSTEM}\n<|user|>\n")
        + " || message || " + _quote("\n<|assistant|>\n") + ") AS chat FROM ("
        + " UNION ALL ".join(
            f"SELECT pair_id, '{target}' AS target, {_render(JUDGE_TEMPLATE, question='prompt', answer_a=a, answer_b=b)} AS message FROM picked"
            for target, a, b in (("A", "chosen", "rejected"), ("B", "rejected", "chosen"))
        )
        + ")",
    ),
    "l1_append_unscored_stream": _with(
        "labelled summaries claim_prompts", "SELECT doc_id, length(prompt)::BIGINT AS score FROM claim_prompts"
    ),
    "l2_scoreboard_stream": _with("verdicts read board outcomes", "SELECT idx, net, outcome FROM outcomes"),
    "m2_task_preference": _with(
        "labelled pref_pairs picked agreed",
        """SELECT pair_id, '<|user|>' || chr(10) || prompt || chr(10) || '<|assistant|>' || chr(10) AS prompt,
        md5(chosen) AS better_answer FROM agreed WHERE length(chosen) > 0""",
    ),
    "m2_task_dialogue": _with(
        "spoken answers transcripts parsed",
        f"""SELECT conv_id, subset, lc <> '' OR len(mc) = 0 AS malformed, {_chat('mc[:-2]')} || '<|assistant|>' || chr(10)
        AS prompt, mc[-1].content AS better_answer FROM parsed""",
    ),
    "m2_task_formula": _with(
        "formula_pairs",
        f"""SELECT pair_id, {_part('pair_id', 2)} AS part,
        {_render(prompts.NL_TO_FORMULA, NL="('Part ' || pair_id || ' is heavy.')")} AS prompt, gold AS FOL FROM formula_pairs""",
    ),
    "m2_task_distill": _with(
        "labelled summaries",
        f"""SELECT doc_id, {_part('doc_id', 0)} AS part,
        md5({_render(prompts.PASSAGE_TO_FORMULA, document='document')}) AS prompt, claim FROM summaries WHERE length(document) >= 200""",
    ),
}

def _reduced(text: str, passes: int = 14) -> str:
    """A formula over T, F and connectives, rewritten until one letter is left; the guards keep the binding order."""
    for _ in range(passes):
        text = rf"regexp_replace({text}, '\(([TF])\)', '\1', 'g')"
        for a, b in (("¬T", "F"), ("¬F", "T"), ("T∧T", "T"), ("T∧F", "F"), ("F∧T", "F"), ("F∧F", "F")):
            text = f"replace({text}, '{a}', '{b}')"
        for before, true, false, after in (
            ("[(→↔]", "T∨T|T∨F|F∨T|T⊕F|F⊕T", "F∨F|T⊕T|F⊕F", "[)∨⊕→↔]"),
            ("[(→↔]", "T→T|F→T|F→F", "T→F", "[)↔]"),
            (r"\(", "T↔T|F↔F", "T↔F|F↔T", "[)↔]"),
        ):
            for cases, value in ((true, "T"), (false, "F")):
                text = rf"regexp_replace({text}, '(^|{before})(?:{cases})($|{after})', '\1{value}\2', 'g')"
    return text


def _assigned(side: str, variable: str = "(list_position({0}_l, l) - 1)") -> str:
    """The formula with the truth values of assignment ``a``: a literal's variable is its bit."""
    return rf"""list_reduce({side}_l, lambda s, l: replace(s, l,
        CASE WHEN (a >> {variable.format(side)}::BIGINT) & 1 = 1 THEN 'T' ELSE 'F' END), {side}_m)"""


_SMALL = f"""SELECT pair_id, replace({_MATRIX.format('gold')}, ' ', '') AS g_m,
    replace({_MATRIX.format('pred')}, ' ', '') AS p_m FROM formula_pairs
    WHERE {' AND '.join(
        f"length({c}) <= 180 AND len(regexp_extract_all({c}, '∧')) <= 5 AND len(regexp_extract_all({c}, '∨')) <= 5"
        for c in ('gold', 'pred'))}"""

# Claims, then one digit of the binding number per claimed prediction, then variables of all predictions.
_CTE |= {
    "best": """SELECT pair_id, gold_pos, pred_pos, similarity FROM similarity QUALIFY row_number() OVER (
        PARTITION BY pair_id, gold_pos ORDER BY greatest(similarity, 0) DESC, pred_pos) = 1""",
    "claimed": """SELECT pair_id, pred_pos, list(gold_pos ORDER BY gold_pos) AS golds, count(*) AS n,
        min(gold_pos) AS first FROM best GROUP BY ALL""",
    "digits": """SELECT *, coalesce(product(n) OVER (PARTITION BY pair_id ORDER BY first
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1)::BIGINT AS weight FROM claimed""",
    "ways": """SELECT pair_id, unnest(range(product(n)::BIGINT)) AS binding_id FROM claimed GROUP BY pair_id""",
    "kept": """SELECT pair_id, binding_id, pred_pos, golds[1 + (binding_id // weight) % n] AS gold_pos
        FROM ways JOIN digits USING (pair_id)""",
    "sizes": """SELECT pair_id, list(literal ORDER BY pos) AS g_l FROM gold_lits GROUP BY 1""",
    "pred_side": """SELECT w.pair_id, w.binding_id, p.pos, p.literal, k.gold_pos,
        CASE WHEN k.gold_pos IS NULL THEN len(g_l) - 1 + sum(CASE WHEN k.gold_pos IS NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY w.pair_id, w.binding_id ORDER BY p.pos) ELSE k.gold_pos END::BIGINT AS var
        FROM ways w JOIN sizes USING (pair_id) JOIN pred_lits p USING (pair_id)
        LEFT JOIN kept k ON k.pair_id = w.pair_id AND k.binding_id = w.binding_id AND k.pred_pos = p.pos""",
    "gold_side": """SELECT w.pair_id, w.binding_id, g.pos, g.literal, k.pred_pos, p.literal AS pred
        FROM ways w JOIN gold_lits g USING (pair_id)
        LEFT JOIN kept k ON k.pair_id = w.pair_id AND k.binding_id = w.binding_id AND k.gold_pos = g.pos
        LEFT JOIN pred_lits p ON p.pair_id = w.pair_id AND p.pos = k.pred_pos""",
}
_CTE |= {
    "bindings": """SELECT pair_id, binding_id, g_l, p_l, p_vars, free, gold_preds, gold_names, len(g_l) + len(free) AS variables
        FROM sizes JOIN (SELECT pair_id, binding_id, list(literal ORDER BY pos) AS p_l, list(var ORDER BY pos) AS p_vars,
            coalesce(list(literal ORDER BY pos) FILTER (gold_pos IS NULL), []) AS free FROM pred_side GROUP BY ALL)
            USING (pair_id)
        JOIN (SELECT pair_id, binding_id, string_agg(coalesce(pred_pos::VARCHAR, '-'), ',' ORDER BY pos) AS gold_preds,
            list(coalesce(pred, '#DUMMY_' || literal) ORDER BY pos) AS gold_names FROM gold_side GROUP BY ALL)
            USING (pair_id, binding_id)""",
}
_BINDING_CTES = (
    "formula_pairs pred_lits gold_lits vectors similarity best claimed digits ways kept sizes pred_side gold_side bindings"
)


def _equivalence(threshold: float | None) -> str:
    weak = (
        ""
        if threshold is None
        else f""" WHERE (pair_id, binding_id) NOT IN (SELECT (k.pair_id, k.binding_id) FROM kept k JOIN best b
            USING (pair_id, gold_pos) WHERE b.similarity < {threshold})"""
    )
    return f""", small AS ({_SMALL}), rows AS (SELECT *, unnest(range((2 ** variables)::BIGINT)) AS a
            FROM bindings JOIN small USING (pair_id){weak}),
        assigned AS (SELECT pair_id, binding_id, {_assigned('g')} AS g,
            {_assigned('p', "p_vars[list_position({0}_l, l)]")} AS p FROM rows),
        texts AS (SELECT DISTINCT g AS t FROM assigned UNION SELECT p FROM assigned),
        known AS MATERIALIZED (SELECT t, {_reduced('t')} AS v FROM texts),
        scored AS (SELECT pair_id, binding_id, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END) AS score FROM assigned
            JOIN known x ON x.t = g JOIN known y ON y.t = p WHERE x.v IN ('T', 'F') AND y.v IN ('T', 'F') GROUP BY ALL),
        top AS (SELECT * FROM scored WHERE score > 0
            QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, binding_id) = 1)
        SELECT pair_id, round(coalesce(score, 0), 6) AS score"""


ORACLES["h7_candidate_bindings"] = _with(
    _BINDING_CTES,
    """SELECT pair_id, binding_id, gold_preds AS gold_pred, array_to_string(p_vars, ',') AS pred_vars, variables::BIGINT
    AS variables FROM bindings""",
)
ORACLES["h8_logical_equivalence"] = _with(
    _BINDING_CTES,
    _equivalence(None)
    + """, array_to_string(g_l || list_transform(free, lambda f: '#DUMMY_' || f), ' ') AS gold_binding,
        array_to_string(gold_names || free, ' ') AS pred_binding
        FROM formula_pairs LEFT JOIN top USING (pair_id) LEFT JOIN bindings USING (pair_id, binding_id)""",
).replace(") , small AS", "), small AS")
ORACLES["h8_logical_equivalence_threshold"] = _with(
    _BINDING_CTES, _equivalence(0.6) + " FROM formula_pairs LEFT JOIN top USING (pair_id)"
).replace(") , small AS", "), small AS")


ORACLES["h6_truth_agreement"] = _with(
    "formula_pairs pred_lits gold_lits",
    f""", small AS ({_SMALL}),
        lists AS (SELECT *, unnest(range((2 ** greatest(len(g_l), len(p_l)))::BIGINT)) AS a FROM small
            JOIN (SELECT pair_id, list(literal ORDER BY pos) AS g_l FROM gold_lits GROUP BY 1) USING (pair_id)
            JOIN (SELECT pair_id, list(literal ORDER BY pos) AS p_l FROM pred_lits GROUP BY 1) USING (pair_id)),
        assigned AS (SELECT pair_id, {_assigned('g')} AS g, {_assigned('p')} AS p FROM lists),
        texts AS (SELECT DISTINCT g AS t FROM assigned UNION SELECT p FROM assigned),
        known AS MATERIALIZED (SELECT t, {_reduced('t')} AS v FROM texts)
        , agreed AS (SELECT pair_id, round(avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0.0 END), 6) AS score FROM assigned
        JOIN known x ON x.t = g JOIN known y ON y.t = p WHERE x.v IN ('T', 'F') AND y.v IN ('T', 'F') GROUP BY pair_id)
        SELECT f.pair_id, score, CASE WHEN s.pair_id IS NULL THEN 'over budget' WHEN score IS NULL THEN 'not well formed' END AS reason
        FROM formula_pairs f LEFT JOIN small s USING (pair_id) LEFT JOIN agreed USING (pair_id)""",
).replace(") , small AS", "), small AS")
ORACLES["k4_report_lines"] = f"""SELECT 'run-1' AS run, subset, metric, value FROM (
    SELECT subset, win, lost, tie, total::DOUBLE AS total, invalid::DOUBLE AS invalid FROM ({ORACLES['k4_win_rates']}))
    UNPIVOT (value FOR metric IN (win, lost, tie, total, invalid))"""
ORACLES["j3_clipped_objective_entropy"] = _with(
    "token_stats",
    f""", cuts AS (SELECT batch_id, quantile_cont(entropy, 0.8) AS cut FROM token_stats WHERE mask = 1 GROUP BY batch_id),
    seqs AS (SELECT batch_id, seq_id, sum(((-least(exp(logp - old_logp) * advantage, {_CLIP('exp(logp - old_logp)', 0.8, 1.2)} * advantage))
        * (mask = 1 AND entropy >= cut)::INT + 0.12 * ({_KL})) * mask) AS l, sum(mask) AS t FROM token_stats JOIN cuts USING (batch_id)
        GROUP BY ALL)
    SELECT batch_id, round(avg(l / greatest(t, 1)), 6) AS loss FROM seqs GROUP BY batch_id""",
).replace(") , cuts AS", "), cuts AS")
ORACLES["m2_task_translation"] = (
    "SELECT seq, direction, prompt FROM (" + ORACLES["f1_bidirectional"] + ")"
)

_EXACT = "coalesce(score, 0) AS score"
_REWARDED = f"""SELECT l_orderkey AS prompt_id, l_partkey AS part_id, l_linenumber AS line_no,
    CASE WHEN l_partkey % 50 <> 7 THEN coalesce(score, 0) END AS score FROM lineitem LEFT JOIN ({ORACLES['h8_logical_equivalence_threshold'].replace('round(coalesce(score, 0), 6) AS score', _EXACT)})
    ON pair_id = l_partkey"""
ORACLES["h11_preference_reward"] = f"SELECT prompt_id, part_id, line_no, round(score, 6) AS reward FROM ({_REWARDED})"
ORACLES["flagship_formula_advantages"] = f"""SELECT prompt_id, part_id, line_no, round(score, 6) AS reward,
    round((score - m) / (s + 1e-4), 6) AS advantage, abs(s) <= 1e-8 AS zero_std FROM (
    SELECT *, avg(score) OVER g AS m, coalesce(stddev_samp(score) OVER g, 0) AS s FROM ({_REWARDED})
    WINDOW g AS (PARTITION BY prompt_id))"""

_FORMULA_BLEU = f"""WITH formula_pairs AS ({_CTE['formula_pairs']}),
    formulas AS (SELECT pair_id, pred, string_split({_MERGED.format('pred')}, ' ') AS hyp,
        string_split({_MERGED.format('gold')}, ' ') AS ref FROM formula_pairs),
    equal AS ({ORACLES['h8_logical_equivalence'].replace('round(coalesce(score, 0), 6) AS score', _EXACT)}),
    {_bleu_counts('formulas', 'pair_id')}"""
ORACLES["h10_formula_reward"] = _FORMULA_BLEU + f""", overlap AS ({_bleu_score('counts', 'pair_id')})
    SELECT pair_id, round(score, 6) AS equivalence, round(bleu, 6) AS bleu,
        round(CASE WHEN length(pred) > 180 THEN 0 ELSE (score + bleu) * 0.5 END, 6) AS reward
    FROM formulas JOIN equal USING (pair_id) JOIN overlap USING (pair_id)"""
ORACLES["h12_formula_evaluation"] = _FORMULA_BLEU + f""", sums AS (SELECT pair_id // 16 AS batch_id, n, sum(t) AS t, sum(m) AS m,
        sum(h) AS h, sum(r) AS r, count(*) AS rows FROM counts GROUP BY ALL),
    overlap AS ({_bleu_score('sums', 'batch_id')})
    SELECT (SELECT count(*) FROM equal) AS rows, (SELECT round(avg(score), 6) FROM equal) AS "LE",
        round(sum(bleu * rows) / sum(rows), 6) AS bleu FROM overlap
    JOIN (SELECT batch_id, max(rows) AS rows FROM sums GROUP BY 1) USING (batch_id)"""

# All permutations by recursion: the list of ranks chosen so far orders them. Each side's truth table is read off once.
ORACLES["h9_logical_equivalence_permuted"] = _with(
    "formula_pairs pred_lits gold_lits",
    f""", small AS ({_SMALL}),
        lists AS MATERIALIZED (SELECT *, greatest(len(g_l), len(p_l)) AS n FROM small
            JOIN (SELECT pair_id, list(literal ORDER BY pos) AS g_l FROM gold_lits GROUP BY 1) USING (pair_id)
            JOIN (SELECT pair_id, list(literal ORDER BY pos) AS p_l FROM pred_lits GROUP BY 1) USING (pair_id)),
        assigned AS (
            SELECT pair_id, 'g' AS side, a, {_assigned('g')} AS t FROM (SELECT *, unnest(range((2 ** len(g_l))::BIGINT)) AS a FROM lists)
            UNION ALL
            SELECT pair_id, 'p', a, {_assigned('p')} FROM (SELECT *, unnest(range((2 ** len(p_l))::BIGINT)) AS a FROM lists)),
        texts AS (SELECT DISTINCT t FROM assigned),
        known AS MATERIALIZED (SELECT t, {_reduced('t')} AS v FROM texts),
        tables AS MATERIALIZED (SELECT pair_id, side, list((v = 'T')::INT ORDER BY a) AS v, bool_and(v IN ('T', 'F')) AS fine
            FROM assigned JOIN known USING (t) GROUP BY ALL),
        named AS MATERIALIZED (SELECT l.pair_id, n, g.v AS gv, p.v AS pv, len(g_l) AS ng, len(p_l) AS np,
                g_l || list_transform(range(n - len(g_l)), lambda i: '#DUMMY_' || i) AS gn,
                p_l || list_transform(range(n - len(p_l)), lambda i: '#DUMMY_' || i) AS pn
            FROM lists l JOIN tables g ON g.pair_id = l.pair_id AND g.side = 'g' AND g.fine
            JOIN tables p ON p.pair_id = l.pair_id AND p.side = 'p' AND p.fine),
        ranks AS MATERIALIZED (SELECT pair_id, i, p, row_number() OVER (PARTITION BY pair_id, i ORDER BY CASE
                WHEN starts_with(gn[i + 1], '#DUMMY_') OR starts_with(pn[p + 1], '#DUMMY_') THEN 10000
                ELSE levenshtein(gn[i + 1], pn[p + 1]) END, p) AS r
            FROM (SELECT *, unnest(range(n)) AS p FROM (SELECT *, unnest(range(n)) AS i FROM named))),
        perms AS (SELECT pair_id, 0::BIGINT AS i, []::BIGINT[] AS perm, []::BIGINT[] AS code FROM named
            UNION ALL
            SELECT pair_id, m.i + 1, m.perm || [k.p], m.code || [k.r] FROM perms m JOIN ranks k USING (pair_id, i)
            WHERE NOT list_contains(m.perm, k.p)),
        placed AS MATERIALIZED (SELECT pair_id, perm, code, n, ng, gv, pv, pn,
                list_transform(range(np), lambda p: list_position(perm, p) - 1) AS places FROM perms JOIN named USING (pair_id) WHERE i = n),
        scored AS (SELECT pair_id, perm, code, pn, list_avg(list_transform(range((2 ** n)::BIGINT), lambda a: (gv[1 + (a & ((1 << ng) - 1))]
                = pv[1 + coalesce(list_sum(list_transform(places, lambda q, i: ((a >> q::BIGINT) & 1) << (i - 1)::BIGINT)), 0)::BIGINT])::INT)) AS score FROM placed),
        top AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, code) = 1)
        SELECT pair_id, round(coalesce(score, 0), 6) AS score,
            array_to_string(list_transform(perm, lambda p: pn[p + 1]), ' ') AS pred_binding FROM formula_pairs LEFT JOIN top USING (pair_id)""",
).replace(") , small AS", "), small AS").replace("WITH formula", "WITH RECURSIVE formula")
