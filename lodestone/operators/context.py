"""Contexts for answers: passages as text, messages, cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fixed

# Formats that answers and their checks rely on.
SEPARATOR = "\n\n---\n\n"
VIA_GRAPH = " · bổ sung qua đồ thị tri thức"
CONTEXT_TITLE, NOTES_TITLE, QUESTION_TITLE = "NGỮ CẢNH:\n\n", "QUAN HỆ RÚT TỪ CẤU TRÚC TÀI LIỆU (dùng để đối chiếu, không phải nguồn để trích dẫn):\n", "CÂU HỎI: "
RULE = "=" * 60
REFUSAL_PREFIX = "Tôi không tìm thấy thông tin này"
UNSUPPORTED_TITLE = "\n\n⚠ Chưa đối chiếu được với tài liệu:\n"

#: Own wording of what a generator and a verifier are asked to do; any other text may be given to the plans.
RULES = (
    "Mọi thông tin phải lấy từ NGỮ CẢNH, kể cả khi bạn biết câu trả lời từ nơi khác.",
    f"Nếu NGỮ CẢNH không đủ để trả lời, viết: {REFUSAL_PREFIX} trong tài liệu hiện có. Có thể gợi ý cách hỏi khác.",
    "Đoạn văn cùng chủ đề chưa chắc đã trả lời câu hỏi; điều không được viết ra thì không tự suy ra.",
    "Khi được hỏi so sánh, nêu dữ liệu của từng bên rồi mới nói giống hay khác; chỉ từ chối nếu thiếu hẳn một bên.",
    "Viết ngắn, vào thẳng nội dung, không nhắc lại câu hỏi.",
    "Con số phải đúng như trong NGỮ CẢNH; không có thì không nêu.",
    "Nếu nhiều nguồn cùng khớp, trả lời riêng cho từng nguồn.",
    "Sau mỗi câu có thông tin, ghi chỉ số đoạn như [1], [2]; không gộp thành khoảng, không thêm chỉ số lạ.",
)
SYSTEM_PROMPT = "Bạn trả lời câu hỏi về một kho tài liệu.\n" + "\n".join(f"{n}. {rule}" for n, rule in enumerate(RULES, 1))
REFUSAL_MESSAGE = REFUSAL_PREFIX + " trong tài liệu hiện có."
ENTAILMENT_PROMPT = "So từng ý của CÂU TRẢ LỜI với NGỮ CẢNH. Viết ĐẠT nếu mọi ý đều có căn cứ, nếu không thì mỗi ý thiếu căn cứ một dòng, bắt đầu bằng '- '.\n\nNGỮ CẢNH:\n%s\n\nCÂU TRẢ LỜI:\n%s"
REWRITE_PROMPT = "Viết lại câu hỏi cuối cho đủ nghĩa khi đứng riêng; chỉ viết câu hỏi.\n\nHỘI THOẠI:\n%s\n\nCÂU HỎI: %s"


def label(source: Column, section: Column) -> Column:
    return F.concat(source, F.lit(" · "), section)


def context_block(hits: Column) -> Column:
    """Numbered passages of array<struct<source_name, section, similarity, via, content>>, each under a line on its origin."""

    def one(h: Column, i: Column) -> Column:
        via = F.when(h["via"] == "graph", F.lit(VIA_GRAPH)).otherwise(F.lit(""))
        return F.format_string("[%d] (nguồn: %s · mục: %s · độ liên quan: %s%s)\n%s", i + 1, h["source_name"], h["section"], fixed(h["similarity"]), via, h["content"])

    return F.array_join(F.transform(hits, one), SEPARATOR)


def user_message(question: Column, hits: Column, notes: Column) -> Column:
    """Context, notes on relations if there are any, and the question."""
    listed = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("- "), n)), "\n")
    parts = F.array(
        F.concat(F.lit(CONTEXT_TITLE), context_block(hits)),
        F.when(F.size(notes) > 0, F.concat(F.lit(NOTES_TITLE), listed)),
        F.concat(F.lit(f"{RULE}\n\n{QUESTION_TITLE}"), question),
    )
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def citations(hits: Column, threshold: float) -> Column:
    """Distinct labels of hits in order, up to the first hit under the threshold that isn't from the graph.

    The first hit always counts. A weak hit also cuts off graph hits behind it.
    """
    weak = F.transform(hits, lambda h, i: F.when((i > 0) & (h["via"] != "graph") & (h["similarity"] < threshold), i))
    stop = F.coalesce(F.array_min(weak), F.size(hits))
    return F.array_distinct(F.transform(F.slice(hits, F.lit(1), stop), lambda h: label(h["source_name"], h["section"])))


def cited_hits(hits: Column, labels: Column) -> Column:
    """The hits whose label is among labels, similarities rounded to four places."""
    shown = F.filter(hits, lambda h: F.array_contains(labels, label(h["source_name"], h["section"])))
    return F.transform(shown, lambda h: F.struct(h["source_name"].alias("source_name"), h["section"].alias("section"), F.round(h["similarity"], 4).alias("similarity"), h["via"].alias("via")))


def is_refusal(text: Column) -> Column:
    return F.startswith(text, F.lit(REFUSAL_PREFIX))


def with_unsupported(text: Column, claims: Column) -> Column:
    """text with a list of claims that could not be confirmed, if there are any."""
    listed = F.array_join(F.transform(claims, lambda c: F.concat(F.lit("  • "), c)), "\n")
    return F.when(F.size(claims) > 0, F.concat(text, F.lit(UNSUPPORTED_TITLE), listed)).otherwise(text)


def gathered(hits: DataFrame, order: str = "rank") -> DataFrame:
    """qid, hits: each question's hits (few: top k and graph hits) as an array in order."""
    fields = F.struct(order, "id", "source_name", "section", "content", "similarity", "via")
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(fields)).alias("hits"))


def appended(vector_hits: DataFrame, graph_hits: DataFrame) -> DataFrame:
    """Vector hits (rank) followed by graph hits (position), with ranks that go on."""
    last = vector_hits.groupBy("qid").agg(F.max("rank").alias("_last"))
    more = graph_hits.join(last, "qid", "left").withColumn("rank", F.coalesce("_last", F.lit(0)) + F.col("position"))
    return vector_hits.unionByName(more.select(vector_hits.columns))


def citation_rows(hits: DataFrame, threshold: float) -> DataFrame:
    """citations() for rows (qid, rank, label, similarity, via): qid, label, rank of its first hit, by a running condition."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (F.col("rank") == 1) | (F.col("via") == "graph") | (F.col("similarity") >= threshold)
    kept = hits.withColumn("_go", F.min(fits).over(order)).where("_go")
    return kept.groupBy("qid", "label").agg(F.min("rank").alias("rank"))
