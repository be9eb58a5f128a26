"""Security notes, pitfalls and code examples, by patterns over lines and chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LEFT, RIGHT, short_id
from ..sources.scratch import spread, written

#: Fixed values: (type, severity, pattern) looked for in every line.
LINE_RULES = (
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|above)\s+instructions{RIGHT}"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}(?:system\s+message|system\s+prompt|system\s+instruction)\s*[:=]"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}you\s+are\s+now\s+(?:an?\s+)?(?:unrestricted|jailbroken|developer\s+mode|dan|evil)(?![A-Za-z0-9_])"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}you\s+are\s+now\s+(?:acting\s+as\s+)?a(?![A-Za-z0-9_]).*?assistant\s+that\s+(?:executes|runs|ignores)"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}IMPORTANT\s+INSTRUCTION\s+FOR\s+(?:THE\s+)?AI\s+AGENT{RIGHT}"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}(?:call|invoke|execute)\s+(?:the\s+)?tool\s+['\"]?[a-zA-Z0-9_-]+['\"]?\s+with{RIGHT}"),
    ("prompt_injection_suspected", "high", rf"(?i){LEFT}use\s+(?:the\s+)?(?:bash|terminal|shell|command|run_command)\s+tool\s+to{RIGHT}"),
    ("prompt_injection_suspected", "medium", rf"(?i){LEFT}do\s+not\s+tell\s+the\s+user{RIGHT}"),
    ("suspicious_instruction", "high", r"(?i)curl\s+-[sS]*[fF]*[kK]*\s+https?://[^\s|]+\s*\|\s*(?:ba)?sh"),
    ("suspicious_instruction", "high", r"(?i)wget\s+-[qO-]*\s+https?://[^\s|]+\s*\|\s*(?:ba)?sh"),
    ("suspicious_instruction", "high", r"(?i)powershell\s+.*-(?:enc|encodedcommand)\s+[A-Za-z0-9+/=]{20,}"),
    ("suspicious_instruction", "high", r"(?i)base64\s+-d\s+.*\|\s*(?:ba)?sh"),
    ("suspicious_instruction", "high", r"(?i)eval\s*\(\s*base64_decode\s*\("),
    ("suspicious_instruction", "high", rf"(?i){LEFT}(?:cat|type)\s+[^\n]*\.(?:ssh/id_[a-zA-Z0-9_-]*|aws/credentials|env)(?![A-Za-z0-9_])"),
    ("suspicious_instruction", "high", rf"(?i){LEFT}(?:curl|wget|fetch|nc|ncat)(?![A-Za-z0-9_])[^\n]*(?:\.ssh/id_|\.aws/credentials|\.env|API_KEY|SECRET){RIGHT}"),
    ("suspicious_instruction", "high", rf"(?i){LEFT}(?:printenv|env)(?![A-Za-z0-9_])[^\n]*\|\s*(?:curl|nc|wget|base64)"),
    ("unsafe_link", "high", r"(?i)\[[^\]]*\]\((?:javascript|data|file):[^)]*\)"),
)
#: Hidden instructions over several lines.
BLOCK_RULES = (
    ("<system> block", r"(?is)<system(?![A-Za-z0-9_])[^>]*>.*?</system>"),
    ("[SYSTEM] block", r"(?is)\[SYSTEM(?:\s+INSTRUCTION)?\].*?\[/SYSTEM(?:\s+INSTRUCTION)?\]"),
    ("ChatML system block", r"(?is)<\|im_start\|>system.*?<\|im_end\|>"),
    ("HTML comment injection", r"(?is)<!--\s*AI\s+INSTRUCTION:.*?-->"),
)
#: Fixed values: (kind, title, pattern) of pitfalls, in order of precedence.
PITFALLS = (
    ("removed", "Removed in", r"(?i)(?:has been removed in|was removed in|removed in version|no longer supported in)\s+([^\n.]+)"),
    ("deprecated", "Deprecated", r"(?i)(?:@deprecated|deprecated since|deprecated in|this (?:method|function|endpoint|parameter|feature) is deprecated|is deprecated; use|deprecated:\s+use)\s+([^\n.]+)"),
    ("breaking_change", "Breaking Change", r"(?i)(?:breaking change:?|breaking in v?\d+|migrating to v?\d+ requires|incompatible with previous)\s*([^\n.]*)"),
    ("server_only", "Server-Only Restriction", r"(?i)(?:can only be called (?:on|from) the server|server-only|server components? only|cannot be imported (?:on|into) the client|never expose.*in client(?:-side)? code)()"),
    ("client_only", "Client-Only Restriction", r"(?i)(?:client-only|can only be called in the browser|client components? only|requires a browser environment|window is not defined)()"),
    ("rate_limit", "Rate Limit Warning", r"(?i)(?:rate limit(?:ed)?|429 too many requests|requests per (?:minute|second|hour)|burst limit|quota exceeded)()"),
    ("security", "Security Requirement", r"(?i)(?:security warning|vulnerability|signature verification failure|never commit (?:your|the) secret|timing attacks?|replay attacks?)()"),
    ("permission", "Permission Requirement", r"(?i)(?:requires permission|requires scope|insufficient privileges|403 forbidden|unauthorized access|must have admin)()"),
    ("required_config", "Required Configuration", r"(?i)(?:must be configured before|environment variable.*is required|missing required config|prerequisite:\s+set)\s+([^\n.]+)"),
    ("runtime_restriction", "Runtime Restriction", r"(?i)(?:not supported in (?:the )?edge runtime|node(?:\.js)? runtime only|requires webcrypto|unsupported platform)()"),
)
MAX_PITFALL = 1500
#: Fixed values: (framework, pattern), first match.
FRAMEWORKS = (
    ("next", r"(?i)from\s+['\"]next(?:/.*)?['\"]|require\(['\"]next(?:/.*)?['\"]\)|'use client'|'use server'"),
    ("react", r"from\s+['\"]react['\"]|require\(['\"]react['\"]\)|useState|useEffect|useMemo|useCallback"),
    ("express", r"(?i)from\s+['\"]express['\"]|require\(['\"]express['\"]\)|express\(\)"),
    ("fastify", r"(?i)from\s+['\"]fastify['\"]|require\(['\"]fastify['\"]\)"),
    ("hono", r"(?i)from\s+['\"]hono['\"]|require\(['\"]hono['\"]\)"),
    ("vue", r"(?i)from\s+['\"]vue['\"]|createApp\(|defineComponent"),
    ("svelte", r"(?i)from\s+['\"]svelte['\"]|<script.*lang=[\"']ts[\"']>"),
    ("fastapi", r"(?i)from\s+fastapi\s+import|FastAPI\("),
    ("flask", r"(?i)from\s+flask\s+import|Flask\(__name__\)"),
    ("django", r"(?i)from\s+django|django\."),
    ("spring", r"(?i)@SpringBootApplication|@RestController|@GetMapping|@PostMapping"),
    ("gin", r"(?i)github\.com/gin-gonic/gin|gin\.Default\(\)"),
)


#: Every rule needs one of these: texts and lines without them are not looked at further.
_HINT = r"(?i)instruction|system|you\s+are\s+now|tool|tell\s+the\s+user|curl|wget|fetch|powershell|base64|env|(?<![a-z0-9_])(?:cat|type|nc|ncat)(?![a-z0-9_])|\]\((?:javascript|data|file):"


def security_annotations(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, type, line, evidence, severity). Texts and lines that may hold something are
    looked at by all rules, which are one array of structs, so nothing is joined. Texts that
    may hold something are written once: all texts are read by one scan, not by one for each rule of blocks."""
    d = spread(docs.select(id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(_HINT))
    d = written(d, "hinted")
    lines = d.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike(_HINT))
    rules = F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(t).alias("type"), F.trim(F.regexp_extract("text", p, 0)).alias("evidence"), F.lit(s).alias("severity"))) for t, s, p in LINE_RULES])
    found = lines.select("id", F.col("line") + 1, F.explode(F.array_compact(rules)).alias("r")).toDF("id", "line", "r").select("id", "r.type", "line", "r.evidence", "r.severity")
    # the line of a block: line ends in what lies between the blocks before it, and in those blocks
    ends = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.size(F.split(t, "\n")) - 1)
    spans = None
    for _, p in BLOCK_RULES:
        some = d.where(F.col("text").rlike(p)).withColumns({"e": F.regexp_extract_all("text", F.lit(p), 0), "between": F.split("text", p)})
        each = some.select("id", "e", "between", F.posexplode("e").alias("i", "evidence"))
        line = 1 + ends(F.slice("between", F.lit(1), F.col("i") + 1)) + ends(F.slice("e", F.lit(1), F.col("i")))
        one = each.select("id", F.lit("prompt_injection_suspected").alias("type"), line.alias("line"), F.trim(F.substring("evidence", 1, 150)).alias("evidence"), F.lit("high").alias("severity"))
        spans = one if spans is None else spans.unionByName(one)
    return found.unionByName(spans)


def _fits(pattern: str) -> Callable[[Column], Column]:
    return lambda x: x.rlike(pattern)


def extract_pitfalls(chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(id, kind, title, content): for each kind the first paragraph that shows it, and
    admonitions; one pitfall per (kind, title)."""
    d = chunks.select(F.col(id_col).alias("id"), F.col("content").alias("text"))
    paragraphs = F.split("text", r"\n\s*\n")
    some = []
    for rank, (kind, title, p) in enumerate(PITFALLS):
        where = F.get(F.filter(paragraphs, _fits(p)), F.lit(0))
        detail = F.trim(F.regexp_extract("text", p, 1))
        name = F.when(detail != "", F.concat(F.lit(title + ": "), F.substring(detail, 1, 60))).otherwise(title)
        some.append(F.when(F.col("text").rlike(p), F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("title"), F.substring(F.coalesce(where, F.col("text")), 1, MAX_PITFALL).alias("content"))))
    notes = F.transform(
        F.regexp_extract_all("text", F.lit(r"(?im)((?:^>[^\n]*(?:\n|$))+)"), 1),
        lambda n: F.when(n.rlike(r"(?i)^>\s*\[!(?:warning|caution|danger|important)\]"), F.struct(F.lit(99).alias("rank"), F.lit("security").alias("kind"), F.concat(F.lit("Notice: "), F.substring(F.regexp_replace(F.regexp_replace(n, r"(?i)^>\s*\[![a-z]+\]\s*", ""), r"(?m)^>\s?|\n", " "), 1, 60)).alias("title"), F.substring(F.regexp_replace(n, r"(?m)^>\s?", ""), 1, MAX_PITFALL).alias("content"))),
    )
    found = d.select("id", F.explode(F.array_compact(F.concat(F.array(*some), notes))).alias("p")).select("id", "p.*")
    return found.withColumn("n", F.row_number().over(W.partitionBy("id", "kind", "title").orderBy("rank", "content"))).where("n = 1").drop("n", "rank")


def framework(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FRAMEWORKS):
        out = F.when(code.rlike(pattern), name).otherwise(out)
    return out


def related_api(code: Column) -> Column:
    call = F.regexp_extract(code, r"(?i)(?<![A-Za-z0-9_])((?:GET|POST|PUT|DELETE|PATCH)\s+/[\w\-/{}]+)", 1)
    path = F.regexp_extract(code, r"https?://[^/\s'\"`]+(/[\w\-/{}.]+)", 1)
    return F.coalesce(F.nullif(call, F.lit("")), F.nullif(path, F.lit("")))


def related_symbol(code: Column) -> Column:
    made = F.regexp_extract(code, r"(?<![A-Za-z0-9_])(?:function|class|def)\s+([A-Za-z_$][\w$]*)", 1)
    called = F.regexp_extract(code, r"(?<![A-Za-z0-9_.])([a-z][\w$]*(?:\.[A-Za-z_$][\w$]*)+)\s*\(", 1)
    return F.coalesce(F.nullif(made, F.lit("")), F.when(~called.rlike(r"^(?:console|JSON|Math|Object|Array|Promise|process)\."), F.nullif(called, F.lit(""))))


def extract_examples(chunks: DataFrame) -> DataFrame:
    """(example_id, chunk_id, language, framework, task, code, related_api, related_symbol)
    of code of 15 and more characters, each once per page."""
    e = chunks.select("page_id", "chunk_id", "ordinal", F.col("title").alias("task"), F.posexplode("code").alias("pos", "c")).select("*", "c.language", "c.code").drop("c")
    e = e.where(F.length(F.trim("code")) >= 15).withColumn("n", F.row_number().over(W.partitionBy("page_id", F.sha2("code", 256)).orderBy("ordinal", "pos"))).where("n = 1")
    return e.select(
        F.concat(F.lit("ex_"), short_id(F.col("page_id"), F.col("code"))).alias("example_id"), "page_id", "chunk_id", "language", framework(F.col("code")).alias("framework"), "task", "code",
        related_api(F.col("code")).alias("related_api"), related_symbol(F.col("code")).alias("related_symbol"),
    )
