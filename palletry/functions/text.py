"""Column functions over code and log texts: fences, tracebacks, objectives, labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of tagged code fences and of the function a rule must define.
CLOSED_FENCE = r"(?s)```(?i:(?:python3?|py))\b\s*(.*?)\s*```"
OPEN_FENCE = r"(?s)```(?i:(?:python3?|py))\b\s*(.*?)\s*(?:```|\z)"
ANY_FENCE = r"(?s)```([^\n]*)\n(.*?)```"
TAGGED_HEADER = r"(?i)^\s*(?:python3?|py)\b"
ENTRY_POINT = "apply_rule_patch"
TRACEBACK_END = "Set the environment variable HYDRA_FULL_ERROR=1"
TRUNCATED = "\n\n… [truncated]"
# What is said of a response without code, by its detail.
NO_CODE = "no_extractable_code"
FAILURES = {
    "python_blocks_without_apply_rule_patch": "Found %d closed ```python``` block(s) but none define apply_rule_patch.",
    "unknown": "Could not extract valid apply_rule_patch code (unexpected).",
    "has_open_python_fence_no_close": "Found a Python-tagged code fence (```python / ```py / …) but no closed block (unclosed fence or truncated response); could not extract apply_rule_patch.",
    "no_python_fence": "No Python-tagged fenced code block (```python, ```py, …) in LLM response.",
}
PREVIEW = 8000
# White space at either end of a text, control characters that count as separators included.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(text, EDGES, "")


def rule_code(response: Column, entry: str = ENTRY_POINT) -> Column:
    """Codes in a response that define the entry point: closed fences, else an open one, else an untagged fence."""
    holds = lambda body: body.contains(entry)
    closed = F.filter(F.transform(F.regexp_extract_all(response, F.lit(CLOSED_FENCE), F.lit(1)), lambda b: F.trim(b)), holds)
    opened = F.regexp_extract(response, OPEN_FENCE, 1)
    headers = F.regexp_extract_all(response, F.lit(ANY_FENCE), F.lit(1))
    bodies = F.regexp_extract_all(response, F.lit(ANY_FENCE), F.lit(2))
    both = F.zip_with(headers, bodies, lambda h, b: F.struct(h.alias("h"), F.regexp_replace(b, r"^\s+|\s+$", "").alias("b")))
    untagged = F.transform(F.filter(both, lambda x: ~x["h"].rlike(TAGGED_HEADER) & holds(x["b"])), lambda x: x["b"])
    none = F.array().cast("array<string>")
    found = F.when(F.size(closed) > 0, closed).when(holds(opened), F.array(opened)).when(F.size(untagged) > 0, F.slice(untagged, 1, 1)).otherwise(none)
    return F.when(response.isNull() | (response == ""), none).otherwise(found)


def failure_detail(response: Column, entry: str = ENTRY_POINT) -> Column:
    """Why a response gave no code."""
    text = F.coalesce(response, F.lit(""))
    closed = F.regexp_extract_all(text, F.lit(CLOSED_FENCE), F.lit(1))
    return (
        F.when((F.size(closed) > 0) & ~F.exists(closed, lambda b: b.contains(entry)), "python_blocks_without_apply_rule_patch")
        .when(F.size(closed) > 0, "unknown")
        .when(text.rlike(r"```(?i:(?:python3?|py))\b"), "has_open_python_fence_no_close")
        .otherwise("no_python_fence")
    )


def failure_info(response: Column, entry: str = ENTRY_POINT, most: int = PREVIEW) -> Column:
    """A struct (kind, message, detail, preview) for a response that gave no code; null for one that gave some."""
    text = F.coalesce(response, F.lit(""))
    blocks = F.size(F.regexp_extract_all(text, F.lit(CLOSED_FENCE), F.lit(1)))
    detail = failure_detail(response, entry)
    message = F.lit(None).cast("string")
    for d, m in FAILURES.items():
        message = F.when(detail == d, F.format_string(m, blocks) if "%d" in m else F.lit(m)).otherwise(message)
    info = F.struct(F.lit(NO_CODE).alias("kind"), message.alias("message"), detail.alias("detail"), truncated(response, most).alias("preview"))
    return F.when(F.size(rule_code(response, entry)) == 0, info)


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters of a stripped text, marked where more follow; empty for no text and for `most` below 1."""
    if most <= 0:
        return F.lit("")
    s = stripped(text)
    return F.when(F.coalesce(s, F.lit("")) == "", "").when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit(TRUNCATED)))


def generated_code(content: Column) -> Column:
    """The first tagged block, even an empty one, else the lines from the last `def` before the first `return` to it;
    imports in front."""
    fence = r"(?s)```python(.*?)```"
    block = F.when(content.rlike(fence), stripped(F.regexp_extract(content, fence, 1)))
    lines = F.split(content, "\n")
    end = F.array_position(F.transform(lines, lambda x: x.contains("return")), F.lit(True)).cast("int")
    head = F.slice(lines, F.lit(1), F.greatest(end, F.lit(1)))
    start = F.array_max(F.transform(head, lambda x, i: F.when(x.startswith("def"), i + 1)))
    between = F.when((end > 0) & start.isNotNull(), F.array_join(F.slice(lines, start, end - start + 1), "\n"))
    code = F.coalesce(block, between)
    code = F.when(code.contains("np"), F.concat(F.lit("import numpy as np\n"), code)).otherwise(code)
    return F.when(code.contains("torch"), F.concat(F.lit("import torch\n"), code)).otherwise(code)


def body_lines(code: Column) -> Column:
    """A function's body: no `def`, `import` and `from` lines, nothing after the first unindented `return`."""
    lines = F.split(code, "\n")
    stop = F.array_position(F.transform(lines, lambda x: x.startswith("return")), F.lit(True)).cast("int")
    head = F.when(stop > 0, F.slice(lines, F.lit(1), F.greatest(stop, F.lit(1)))).otherwise(lines)
    return F.array_join(F.filter(head, lambda x: ~x.rlike("^(def|import|from)")), "\n")


def traceback(log: Column) -> Column:
    """From the first line that starts with Traceback to the hint that ends it; empty if there is none."""
    lines = F.split(log, "\n")
    start = F.array_position(F.transform(lines, lambda x: x.startswith("Traceback")), F.lit(True)).cast("int")
    tail = F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))
    stop = F.array_position(F.transform(tail, lambda x: x.contains(TRACEBACK_END)), F.lit(True)).cast("int")
    tail = F.when(stop > 0, F.slice(tail, F.lit(1), stop - 1)).otherwise(tail)
    return F.when(start > 0, F.array_join(tail, "\n")).otherwise("")


def description(response: Column) -> Column:
    """Text between <start> and the code block, else between <start> and <end>."""
    found = lambda pattern: F.when(response.rlike(pattern), stripped(F.regexp_extract(response, pattern, 1)))
    return F.coalesce(found(r"(?s)<start>(.*?)```python"), found(r"(?s)<start>(.*?)<end>"))


def objective(stdout: Column, maximise: bool = False) -> Column:
    """The second-last line as a number; infinity where that fails, the sign turned for maximisation."""
    lines = F.split(stdout, "\n")
    value = F.try_element_at(lines, F.lit(-2)).try_cast("double")
    return F.coalesce(-value if maximise else value, F.lit(float("inf")))


def slug(name: Column) -> Column:
    """A model name as one path part: path separators and colons become underscores one by one, white space in runs."""
    s = F.regexp_replace(F.regexp_replace(stripped(name), r"[\\/:]", "_"), r"(?U)[\s\x1c-\x1f]+", "_")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown_model"))


def short_id(code: Column) -> Column:
    return F.substring(F.md5(code), 1, 6)


def fixed(x: Column, digits: int = 4, sign: bool = False) -> Column:
    """A number with so many digits after the point, with a plus sign if wanted; null stays null. Halves go up."""
    return F.when(x.isNotNull(), F.format_string(f"%{'+' * sign}.{digits}f", x.cast("double")))


def general(x: Column, digits: int = 6) -> Column:
    """A number with so many significant digits, without trailing zeros, in powers of ten outside 1e-4 to 10**digits."""
    x = x.cast("double")
    parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    power = parts[1].cast("int")
    out = F.concat(bare(parts[0]), F.lit("e"), parts[1])
    for k in range(-4, digits):
        out = F.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", x))).otherwise(out)
    plain = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(plain, out))


def names(listed: Column) -> Column:
    """The names of a comma-separated list: lower case, trimmed, without empty ones, each at its first place."""
    return F.array_distinct(F.filter(F.transform(F.split(listed, ","), lambda n: F.lower(stripped(n))), lambda n: n != ""))


def run_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def model_file(run: Column, folder: str = "models") -> Column:
    """The model file that belongs to a run's folder name `exp_...`; null for other names."""
    return F.when(run.startswith("exp_"), F.concat(F.lit(f"{folder}/linear_svm_"), F.substring(run, 5, 2**30), F.lit(".json")))


def once(value: Column, then) -> Column:
    """`then(value)`, where `value` is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def route_line(line: Column) -> Column:
    """A struct of a route file's line: (depot, customers, capacity, demand, cost, node_flag).

    The fields follow their names, comma-separated. Coordinates come as structs (x, y); demand is that of the depot, 0, first,
    whether the line has it or not; node_flag pairs each visited node with 1 where a route starts. Lacking fields are null.
    """
    places = lambda parts: F.struct(*[F.array_position(parts, n).cast("int").alias(n) for n in ROUTE], (F.size(parts) + 1).alias("end"))
    return once(F.split(F.trim(line), r"\s*,\s*"), lambda parts: once(places(parts), lambda at: _route(parts, at)))


#: Names of a route line's fields.
ROUTE = ("depot", "customer", "capacity", "demand", "cost", "node_flag")


def _route(parts: Column, at: Column) -> Column:
    """The struct of a line's parts; `at` has the place of each name, sought once, and of the end."""

    def after(name: str, until: str) -> Column:
        start, end = at[name], at[until]
        return F.when((start > 0) & (end > start), F.slice(parts, start + 1, end - start - 1))

    def places(n: Column) -> Column:
        return F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1)

    def points(v: Column) -> Column:
        point = lambda i: F.struct(F.get(v, i * 2).alias("x"), F.get(v, i * 2 + 1).alias("y"))
        return F.when(F.size(v) >= 2, F.transform(places(F.size(v)), point))

    def visits(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        pairs = F.arrays_zip(F.slice(v, F.lit(1), half), F.slice(v, half + 1, half))
        return F.when(half > 0, pairs.cast("array<struct<node:int,from_depot:int>>"))

    numbers = lambda name, until, kind: after(name, until).try_cast(f"array<{kind}>")
    return F.struct(
        F.get(once(numbers("depot", "customer", "double"), points), F.lit(0)).alias("depot"),
        once(numbers("customer", "capacity", "double"), points).alias("customers"),
        F.get(numbers("capacity", "demand", "double"), F.lit(0)).cast("int").alias("capacity"),
        once(numbers("demand", "cost", "int"), lambda v: F.when(F.get(v, F.lit(0)) == 0, v).otherwise(F.concat(F.array(F.lit(0)), v))).alias("demand"),
        F.get(numbers("cost", "node_flag", "double"), F.lit(0)).alias("cost"),
        once(numbers("node_flag", "end", "int"), visits).alias("node_flag"),
    )


def case_line(dispatch: Column, prob: Column, gt: Column, features: dict[str, Column]) -> Column:
    """One readable line for a case; missing features read N/A."""
    parts = [F.format_string("dispatch=%s prob=%.4f gt=%s", dispatch.cast("string"), prob, gt.cast("string"))]
    parts += [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("N/A"))) for k, v in features.items()]
    return F.concat_ws(", ", *parts)
