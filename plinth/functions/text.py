"""Text functions as Spark columns. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"
CJK = r"[㐀-䶿一-鿿]"

# Patterns and word lists that results depend on.
BOX = "─━│┃┏┓┗┛├┤┬┴┼┄┅┆┇┈┉┊┋"
NOISE = {
    "box_drawing": f"[{BOX}]",
    "irregular_spacing": r"\S\s{3,}\S",
    "char_repetition": r"(.)\1{4,}",
    "page_number_header": r"^第\d+页|^\s*Page\s*\d+\s*$",
    "repeated_header": r"^(碳纤维|Carbon Fiber|CFRP|第\d+章|Chapter\s+\d+)\s*$",
    "garbled_unicode": r"[^\p{L}\p{N}_\s\u4e00-\u9fff\u3000-\u303f\uff00-\uffef.,;:!?()\[\]{}\"'/@#$%&*-+=<>~°μΩαβγδεηθλπσφψω℃±×÷≈≠≤≥∝∞∫∑∂√∇≡⊥∠∥∏]",
    "broken_line_hyphen": r"-\s*\n\s*",
}
HEADERS = [r"第\d+页", r"Page\s*\d+", r"\d+$", r"第\d+章\s*.*$", r"Chapter\s+\d+", r"目\s*录$", r"Contents$", r"碳纤维.*丛书$", r"Carbon Fiber.*Series$"]
FORMULA = [r"[=≈≠≤≥±×÷∝∞∫∑∂√∇≡]", r"[αβγδεηθλπσφψωμΩ]", r"\b\d+\s*[°%℃]\b", r"[Ee]\s*[=≈]\s*[\d.×]+", r"σ|ρ|ε|η|ν|ξ|λ|μ|κ|τ", r"\\frac|\\sqrt|\\int|\\sum|\\prod", r"[＋－×÷＝≠≈≤≥]"]
TABULAR = [r"(\S+\s{2,}\S+\s{2,}\S+\s{2,}\S+)", r"[│┃┤├┬┴┼─━┏┓┗┛]", r"^\s*\S+\t\S+", r"表\s*\d+", r"Table\s+\d+", r"[┌┬┐├┼┤└┴┘]"]
DOMAIN_TERMS = ["碳纤维", "复合材料", "CFRP", "碳化", "纤维", "树脂", "基体", "carbon", "fiber", "composite", "PAN", "预浸料", "层压"]
DOMAIN_KEYWORDS = [
    "碳纤维", "碳素纤维", "碳丝", "碳化", "石墨化", "PAN", "聚丙烯腈", "预浸料", "prepreg", "复合材料", "composite", "基体", "增强", "纤维", "fiber", "fibre", "纺丝", "spinning", "原丝", "力学性能", "拉伸", "压缩", "弯曲", "剪切", "模量", "强度", "固化", "cure", "树脂", "resin", "环氧", "epoxy",
    "T300", "T700", "T800", "M40", "M55", "M60", "碳纤维布", "碳纤维板", "碳纤维管", "碳纤维加固", "复合材料制备", "成型工艺", "RTM", "真空袋", "热压罐", "层间剪切", "界面", "interfacial", "表面处理", "碳纤维生产", "碳纤维制造", "氧化炉", "碳化炉",
]
LABELS = {
    "stage:precursor": ["precursor", "前驱体"], "stage:spinning": ["spinning", "纺丝"], "stage:oxidation": ["oxidation", "stabilization", "预氧化"],
    "stage:carbonization": ["carbonization", "graphitization", "碳化", "石墨化"], "stage:surface_treatment": ["surface treatment", "sizing", "上浆", "表面处理"],
    "stage:weaving": ["weaving", "braiding", "织机", "编织"], "stage:prepreg": ["prepreg", "预浸料"], "stage:forming": ["rtm", "infusion", "autoclave", "molding", "成型", "热压罐"],
    "stage:testing": ["testing", "test", "试验", "测试"], "stage:ndt": ["ndt", "non destructive", "ct scan", "x ray", "红外", "无损"], "stage:microstructure": ["sem", "micrograph", "显微", "断面"],
    "app:aerospace": ["aircraft", "aerospace", "satellite", "rocket", "飞机", "航天"], "app:automotive": ["automotive", "car", "motorcycle", "汽车", "摩托"], "app:energy": ["wind turbine", "blade", "风电"],
    "app:pressure_vessel": ["hydrogen tank", "pressure vessel", "气瓶", "压力容器"], "app:sport": ["bicycle", "sports", "tennis", "helmet", "自行车", "运动"], "app:medical": ["prosthetic", "medical", "义肢", "假肢", "医疗"],
}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_text(c: Column) -> Column:
    """Lower case, runs of white space as one blank, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), WHITE, " "))


def text_hash(c: Column) -> Column:
    """MD5 of the normalised text."""
    return F.md5(normalize_text(c).cast("binary"))


def content_hash(c: Column) -> Column:
    """First 16 hex digits of the text's SHA-256."""
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def detect_language(c: Column) -> Column:
    """``zh`` if CJK characters exceed 0.3 of the letters, ``en`` if letters exceed 3 times the CJK, else ``unknown``."""
    zh, en = F.regexp_count(c, F.lit(CJK)), F.regexp_count(c, F.lit("[a-zA-Z]"))
    return F.when(zh > en * 0.3, "zh").when(en > zh * 3, "en").when(c.isNotNull(), "unknown")


def is_chinese(c: Column, share: float = 0.3) -> Column:
    return F.regexp_count(c, F.lit(CJK)) > F.length(c) * share


def noise_issues(c: Column) -> Column:
    """Names of the noise patterns found, in fixed order; only ``empty_page`` below 15 characters."""
    found = F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for n, p in NOISE.items()]))
    return F.when(F.length(strip(c)) < 15, F.array(F.lit("empty_page"))).when(c.isNotNull(), found)


def is_header_footer(c: Column, least: int = 3, most: int = 120) -> Column:
    s = strip(c)
    return F.length(s).between(least, most) & s.rlike("(?i)^(?:" + "|".join(HEADERS) + ")")


def chunk_type(c: Column, formula_guess: Column | None = None) -> Column:
    """body, formula, table, table_uncertain, mixed or empty, by matching patterns per 50 characters."""
    s = strip(c)
    per = F.greatest(F.length(s) / 50, F.lit(1.0))
    hits = lambda ps: sum((s.rlike(p).cast("int") for p in ps), F.lit(0))
    formula = hits(FORMULA) / per + (F.when(F.coalesce(formula_guess, F.lit(False)), 2).otherwise(0) if formula_guess is not None else 0)
    tabular = hits(TABULAR) / per
    box = "─━│┃┏┓┗┛├┤┬┴┼┄┅┆┇┈┉┊┋┌┐└┘"
    damaged = F.regexp_count(s, F.lit(f"[{box}]")) > F.length(F.regexp_replace(s, f"(?U)[{box}\\s]", "")) * 0.5
    return F.when(F.length(s) < 15, "empty").when((formula >= 2) & (tabular >= 2), "mixed").when(formula >= 2, "formula").when(tabular >= 2, F.when(damaged, "table_uncertain").otherwise("table")).when(c.isNotNull(), "body")


def exam_text(c: Column) -> Column:
    """Exam text for comparison: one blank between words, no leading number, plain punctuation, lower case."""
    one = F.trim(F.regexp_replace(c, WHITE, " "))
    return F.trim(F.lower(F.translate(F.regexp_replace(one, r"(?U)^[0-9]+[.、．)\s]+", ""), "，。；（）", ",.;()")))


def exam_options(c: Column) -> Column:
    """Options (key, text) sorted by key as ``KEY:text`` joined by ``|``; null and empty give an empty string."""
    parts = F.transform(F.array_sort(c), lambda o: F.concat(F.upper(F.coalesce(o["key"], F.lit(""))), F.lit(":"), exam_text(F.coalesce(o["text"], F.lit("")))))
    return F.coalesce(F.array_join(parts, "|"), F.lit(""))


def word_set(c: Column, least: int = 3) -> Column:
    """Distinct lower-case words of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items: 1 if both are empty, 0 if one is."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.try_divide(n.cast("double"), F.size(a) + F.size(b) - n))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the length, rounded down; null is 0."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / 4)


def contains_any(c: Column, terms: list[str], ignore_case: bool = False) -> Column:
    c = F.lower(c) if ignore_case else c
    return F.exists(F.array(*[F.lit(t.lower() if ignore_case else t) for t in terms]), lambda t: c.contains(t))


def keyword_labels(c: Column) -> Column:
    """Weak labels of a keyword by the terms in it, and its language."""
    some = [F.when(contains_any(c, terms, True), F.lit(name)) for name, terms in LABELS.items()]
    return F.array_compact(F.array(F.lit("domain:carbon_fiber"), *some, F.when(c.rlike("[一-鿿]"), "lang:zh").otherwise("lang:en")))


def slug(c: Column, most: int = 40) -> Column:
    """Lower case, ``_`` for blanks, only a-z, 0-9, ``_`` and CJK, cut to ``most``; ``kw`` if nothing is left."""
    s = F.substring(F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), "[^a-z0-9_一-龥]", ""), 1, most)
    return F.when(s == "", "kw").otherwise(s)


def resolvable(refs: Column) -> Column:
    """Whether any source reference has a form that can be resolved."""
    return F.coalesce(F.exists(refs, lambda r: F.coalesce(r.rlike(r"^(data/|text_raw_data/|chunk_|exam_|img_)"), F.lit(False))), F.lit(False))


def stable_id(prefix: str, *cols: Column) -> Column:
    """``prefix`` and 12 hex digits of the MD5 of the columns."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *cols).cast("binary")), 1, 12))


def mask_secrets(c: Column) -> Column:
    """API keys, bearer tokens, e-mail addresses and long digit runs replaced by a mark."""
    c = F.regexp_replace(c, r"(?i)\b(?:sk|ak|key|token)[-_][A-Za-z0-9]{16,}", "[key]")
    c = F.regexp_replace(c, r"(?i)bearer\s+[A-Za-z0-9._-]{12,}", "[token]")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[mail]")
    return F.regexp_replace(c, r"\b\d{11,}\b", "[number]")
