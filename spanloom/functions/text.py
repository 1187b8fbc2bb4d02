"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in similarity and retrieval.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "have", "had", "not", "you", "your", "will", "would", "can", "could", "should", "into", "about", "then", "than", "them", "they", "their", "there")
TOKEN = r"[a-zA-Z0-9_\-]{3,}"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, stop words left out; none for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(found, lambda x: ~F.array_contains(stop, x))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets, 0 if either is empty."""
    both, one = F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")
    return F.when(one > 0, both / one).otherwise(F.lit(0.0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shortened(text: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being dots."""
    t = strip(text)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 3)), F.lit("..."))).otherwise(t)


def fingerprint(text: Column, n: int = 800) -> Column:
    """Lower case, runs of white space as one space, first n characters: equal for texts that count as one node."""
    return F.left(strip(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(n))


def middle_cut(text: Column, limit: int, marker: str = "\n...[cut]...\n") -> Column:
    """Two thirds head and one third tail around a marker, at most ``limit`` characters."""
    room = max(0, limit - len(marker))
    head = room * 2 // 3
    cut = F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(room - head)))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def token_estimate(text: Column) -> Column:
    """Rough count of model tokens: each CJK character, a third of ASCII, half of the rest."""
    t = F.coalesce(text, F.lit(""))
    # runs, not characters, are taken out: each match costs
    cjk = F.length(F.regexp_replace(t, r"[^\x{4e00}-\x{9fff}]+", ""))
    ascii_ = F.length(F.regexp_replace(t, r"[^\x00-\x7f]+", ""))
    other = F.length(t) - cjk - ascii_
    return cjk + F.floor((ascii_ + 2) / 3).cast("int") + F.floor((other + 1) / 2).cast("int")


def content_flags(text: Column) -> dict[str, Column]:
    """What a text shows: tags, numbers, failure words, a final answer, a tool name, JSON."""
    t = F.coalesce(text, F.lit(""))
    return {
        "has_tag": t.rlike(r"<[^>]+>"),
        "has_number": t.rlike(r"\d"),
        "has_error_terms": F.lower(t).rlike(r"error|failed|exception|timeout|invalid|missing"),
        "has_final_answer": F.lower(t).contains("final answer"),
        "has_tool": t.rlike(r"(?:Tool|Function):\s*\S"),
        "json_like": strip(t).rlike(r"^[\[{]"),
    }


def ids_in(text: Column) -> Column:
    """Span ids of 16 hex digits and node ids such as F_12, lower-cased, in order and once each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[0-9a-f]{16}|[ipafce]_[0-9]+"), 0))


def tool_name(text: Column) -> Column:
    """Name after 'Tool:' or 'Function:'; empty if none."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:Tool|Function):\s*([A-Za-z0-9_\-.]+)", 1)


def artifact_keys(text: Column) -> Column:
    """Generated object ids and file names in a text, once each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"cx_[0-9]{3}_[a-z0-9_]+|[a-z0-9_\-]+\.(?:json|txt|pkl|md|csv|yaml|yml)"), 0))


def bytes_label(n: Column) -> Column:
    """A byte count with a binary unit and one decimal."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.format_string("%.1f TiB", F.round(n / F.lit(1024.0**4), 1))
    for k in range(len(units) - 2, -1, -1):
        out = F.when(n < F.lit(1024.0 ** (k + 1)), F.format_string(f"%.1f {units[k]}", F.round(n / F.lit(1024.0**k), 1))).otherwise(out)
    return F.when(n.isNotNull(), out)


def safe_id(text: Column) -> Column:
    """An id that is fit for a file name."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_")


def required_tags(prompt: Column) -> Column:
    """Tags that a prompt asks for, such as <answer>, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(r"<[a-zA-Z_][a-zA-Z0-9_]*>"), 0))


def missing_tags(prompt: Column, output: Column) -> Column:
    """Required tags that the output doesn't hold."""
    return F.filter(required_tags(prompt), lambda t: F.instr(F.coalesce(output, F.lit("")), t) == 0)


def canonical_speaker(name: Column, role: Column) -> Column:
    """A speaker without a suffix such as (thought) or (-> Other); the role stands in for a blank one."""
    bare = strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\((?:thought|.*->.*)\)\s*$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.initcap(F.coalesce(role, F.lit("unknown"))))


def is_control_message(text: Column) -> Column:
    """Turns that only steer the dialogue."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return t.isin("terminate", "done", "stop") | t.startswith("next speaker")


def final_answer(text: Column) -> Column:
    """What follows 'final answer:', up to an empty line; null if there is none."""
    return F.nullif(strip(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)final answer\s*[:：]\s*([^\n]+)", 1)), F.lit(""))


def dates(text: Column) -> Column:
    """Dates in a text as yyyy-MM-dd, once each: 2024-01-31, 2024/1/31 and 2024年1月31日."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit(r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}"), 0)
    parts = F.transform(found, lambda x: F.split(x, r"[-/年月]"))
    return F.array_distinct(F.transform(parts, lambda p: F.concat_ws("-", p[0], F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0"))))


# Units of measures, and headings of results that carry no fact.
MEASURE = r"(?i)(?<![\p{L}\p{N}_])[<>]?\d+(?:\.\d+)?\s*(?:℃|°C|%|级|km|m|kg|g|ms|s|秒|分钟|小时|元|美元|MB|GB)"
HEADING = r"(?i)^(?:URL|Status|Title|Provider|Content|Query|Source):"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def fact_signatures(text: Column) -> Column:
    """What marks a result, without white space, once each: measures with their units, and short lines with a letter that aren't headings."""
    t = F.coalesce(text, F.lit(""))
    dense = lambda x: F.regexp_replace(x, r"\s+", "")
    measures = F.transform(F.regexp_extract_all(t, F.lit(MEASURE), 0), dense)
    lines = F.transform(F.split(t, LINE_END), lambda x: strip(F.regexp_replace(x, r"[*#|]", "")))
    short = F.filter(lines, lambda x: F.length(x).between(2, 24) & ~x.rlike(HEADING) & x.rlike(r"[\u4e00-\u9fffA-Za-z]"))
    return F.array_distinct(F.concat(measures, F.transform(short, dense)))


def opaque_arguments(arguments: Column, url: Column) -> Column:
    """Identifiers among a call's arguments that can't be guessed: long parts of its URL, and values of id-like keys."""
    parts = F.filter(F.regexp_extract_all(url, F.lit(r"(?<=[/=])([A-Za-z0-9_-]{7,})(?=[/?#.&]|$)"), 1), lambda x: x.rlike(r"\d") | (F.length(x) >= 16))
    pairs = F.map_entries(F.coalesce(F.from_json(arguments, "map<string,string>"), F.create_map().cast("map<string,string>")))
    held = F.transform(F.filter(pairs, lambda e: e["key"].rlike(r"(?i)(?:^|_)(?:id|code|key|path|resource)(?:$|_)") & e["value"].rlike(r"^[A-Za-z0-9_-]{7,}$")), lambda e: e["value"])
    return F.array_distinct(F.concat(parts, held))


def task_terms(text: Column) -> Column:
    """What a task is about: objects of its verbs, and words in quotation marks."""
    t = F.coalesce(text, F.lit(""))
    verbs = r"(?:查询|搜索|查看|获取|分析|读取|比较|检查|打开|下载|调用|验证)([\u4e00-\u9fffA-Za-z0-9_-]{2,16}?)(?:今天|今日|当前|的|数据|信息|情况|文件|网页|页面|报告|内容|结果|$)"
    quoted = F.flatten(F.transform(F.regexp_extract_all(t, F.lit(r"[\"“]([^\"”]{2,40})[\"”]"), 1), lambda q: F.regexp_extract_all(q, F.lit(r"[\u4e00-\u9fff]{2,8}|[A-Za-z][A-Za-z0-9_-]{2,}"), 0)))
    return F.array_distinct(F.filter(F.concat(F.regexp_extract_all(t, F.lit(verbs), 1), quoted), lambda x: ~x.isin("相关", "详细", "一下", "一下子")))


# Words without meaning when a trace's nodes are compared with its outcome.
LEXICAL_STOP = ("the", "and", "for", "with", "that", "this", "from", "into", "then", "have", "has", "had", "will", "need", "tool", "args", "params", "output", "input", "message", "step", "final", "answer")


def lexical_tokens(text: Column) -> Column:
    """Lower-cased tokens, paths in one piece, once each."""
    stop = F.array(*[F.lit(w) for w in LEXICAL_STOP])
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9_\-/]{3,}"), 0), F.lower)
    return F.array_distinct(F.filter(found, lambda x: ~F.array_contains(stop, x)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common tokens over those of the smaller set, 0 if the second is empty."""
    return F.when(F.size(b) > 0, F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.least(F.size(a), F.size(b)))).otherwise(F.lit(0.0))


def path_parts(text: Column) -> Column:
    """Nodes of a causal path written as ``a -> b``, ``a, b`` or ``a b``, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"->|→|,|\s+"), strip), lambda x: x != "")


def id_list(text: Column) -> Column:
    """Ids of a list with commas, once each in order, blank ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != ""))


def dumped(value: Column, most: int) -> Column:
    """A value as JSON of at most ``most`` characters, the cut marked."""
    t = F.to_json(value)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("...[truncated]"))).otherwise(t)


def stringified(value: Column, kind: str) -> Column:
    """A value as text: strings as they are, null as an empty one, all else as JSON."""
    if kind == "string":
        return F.coalesce(value, F.lit(""))
    return F.coalesce(F.to_json(value) if kind.startswith(("struct", "array", "map", "variant")) else value.cast("string"), F.lit(""))


def task_of_input(text: Column) -> Column:
    """The task that an input names: the first of its fields task, query, question and input, else the text itself."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.nullif(strip(F.get_json_object(t, f"$.{k}")), F.lit("")) for k in ("task", "query", "question", "input")], strip(t))


def token_cut(text: Column, most: int, marker: str = "\n...[cut]...\n") -> Column:
    """``middle_cut`` to an estimated number of tokens: the most characters, by halving steps, whose cut text stays within it."""
    t = F.coalesce(text, F.lit(""))

    def cut(n: Column) -> Column:
        head = F.floor(n * 2 / 3).cast("int")
        return F.concat(F.left(t, head), F.lit(marker), F.right(t, (n - head).cast("int")))

    halves = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    room = F.aggregate(halves, F.lit(0), lambda acc, step: F.when((acc + step < F.length(t)) & (token_estimate(cut(acc + step)) <= most), acc + step).otherwise(acc))
    return F.when(token_estimate(t) <= most, t).otherwise(F.get(F.transform(F.array(room), cut), F.lit(0)))  # the room is used three times and found once


def opaque_tokens(text: Column) -> Column:
    """Values of id-like keys in a text, once each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:id|key|token|uuid)\"?\s*[:=]\s*\"?([A-Za-z0-9_\-]{6,})"), 1))
