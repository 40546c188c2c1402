"""Predicates and classifiers that route questions and sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip

# Markers and rules, in the order that counts.
#: A question with one of these, anywhere in its lower-case text, may depend on what was said before.
DEPENDENT_MARKERS = (
    "nó", "đó", "này", "kia", "ấy", "vậy", "thế", "họ", "chúng",
    "còn", "thì sao", "ra sao", "tương tự", "cái đó", "cái này",
    "loại đó", "game đó", "game này", "trên", "vừa rồi", "ở đâu",
)
#: A question with one of these compares, and may need more than one subject's passages.
COMPARE_MARKERS = (
    "so sánh", "giống", "tương tự", "khác nhau", "khác gì", "đối chiếu",
    "cả hai", "hai game", "game khác", "bên nào", "còn", "thì sao", "tương đương",
)
#: The first part that a section title holds gives the kind of what the section defines.
KIND_RULES = (
    ("mục tiêu", "mục tiêu trung lập"),
    ("đấu trường", "bản đồ thi đấu"),
    ("vị trí", "vị trí"),
    ("bản đồ", "vị trí"),
    ("thuật ngữ", "thuật ngữ"),
    ("nguyên tố", "nguyên tố"),
    ("vùng đất", "vùng đất"),
    ("giải đấu", "giải đấu"),
    ("tướng", "nhóm tướng"),
    ("gacha", "gacha"),
    ("trang bị", "trang bị"),
    ("ngọc", "trang bị"),
    ("chế độ", "chế độ chơi"),
    ("xếp hạng", "xếp hạng"),
    ("nâng cấp", "nâng cấp nhân vật"),
    ("hoạt động", "hoạt động thường ngày"),
)
DEFAULT_KIND = "khái niệm"
OVERVIEW, OVERVIEW_KIND, TOPIC_KIND = "## Tổng quan", "game", "chủ đề"
SHORT_QUESTION = 30


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether the lower-case text holds one of parts, also inside other words."""
    return F.exists(F.array(*map(F.lit, parts)), lambda part: F.contains(F.lower(text), part))


def needs_rewrite(question: Column, markers: Sequence[str] = DEPENDENT_MARKERS, short: int = SHORT_QUESTION) -> Column:
    return (F.length(F.lower(question)) < short) | contains_any(question, markers)


def needs_expansion(question: Column, markers: Sequence[str] = COMPARE_MARKERS) -> Column:
    return contains_any(question, markers)


def classify(title: Column, rules: Sequence[tuple[str, str]] = KIND_RULES, default: str = DEFAULT_KIND) -> Column:
    """The kind of the first rule whose part the lower-case title holds."""
    low = F.lower(title)
    found = F.lit(default)
    for part, kind in reversed(rules):
        found = F.when(F.contains(low, F.lit(part)), F.lit(kind)).otherwise(found)
    return found


def document_kind(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(OVERVIEW)), F.lit(OVERVIEW_KIND)).otherwise(F.lit(TOPIC_KIND))


def refused(top: Column, threshold: float) -> Column:
    """Whether the best similarity (null: no hit, 0) is strictly under the threshold."""
    return F.coalesce(top, F.lit(0.0)) < threshold


def accepted_rewrite(question: Column, rewritten: Column, longer: int = 200) -> Column:
    """The rewritten question, stripped of white space and quotes, unless it is empty or far longer; then the question."""
    clean = F.regexp_replace(strip(rewritten), '^"+|"+$', "")
    return F.when((F.length(clean) > 0) & (F.length(clean) < F.length(question) + longer), clean).otherwise(question)


def valid_request(session: Column, question: Column) -> Column:
    """1 to 128 characters of a session's name, 1 to 2000 of a question."""
    return F.coalesce(F.length(session).between(1, 128) & F.length(question).between(1, 2000), F.lit(False))


def usable_model(name: Column, blocked: Sequence[str]) -> Column:
    """Whether a model's name holds none of the blocked parts."""
    return ~F.exists(F.array(*map(F.lit, blocked)), lambda part: F.contains(name, part))


def model_order(name: Column) -> list[Column]:
    """Sort keys: final releases before previews and experiments, quick ones first, then by name."""
    return [F.contains(name, F.lit("preview")) | F.contains(name, F.lit("exp")), ~F.contains(name, F.lit("flash")), name]
