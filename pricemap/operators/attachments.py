"""Which attachment of a message is the quotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricemap.functions.text import file_tokens, is_budget_file
from pricemap.operators.terms import near_terms

# Words and prefixes of file names that speak for and against a quotation.
POSITIVE = ["orcamento", "orc", "cotacao", "cot", "proposta", "preco", "precos", "precificacao", "planilha", "plan", "itens", "lote", "mapa", "valor", "valores", "comercial", "fornecedor"]
NEGATIVE = [
    "catalogo", "brochura", "portfolio", "manual", "foto", "fotos", "imagem", "imagens", "produto", "produtos", "logo", "banner", "assinatura", "rodape",
    "xml", "nfe", "danfe", "boleto", "comprovante", "nota", "pedido", "ordem", "romaneio", "certidao", "certificado", "ficha",
]
NEGATIVE_PREFIXES = ["img", "image", "imagem", "foto", "whatsapp", "assinatura", "logo", "banner", "icon"]
PDF_WORDS = ["cotacao", "proposta", "orcamento"]


#: Least ratio of a word that is nearly one of the terms.
NEAR_NEGATIVE, NEAR_POSITIVE = 0.85, 0.82


def _exact(tokens: Column, terms: list[str]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in terms])))


def name_hits(names: DataFrame) -> DataFrame:
    """(low, negative, positive) per different lower-cased file ``name``: how many of its words are, or nearly are, among the terms."""
    low = names.select(F.lower(F.coalesce("name", F.lit(""))).alias("low")).distinct().withColumn("tokens", file_tokens(F.col("low")))
    words = low.select("low", F.explode("tokens").alias("token"))
    out = low.select("low")
    for kind, terms, least in (("negative", NEGATIVE, NEAR_NEGATIVE), ("positive", POSITIVE, NEAR_POSITIVE)):
        # a term itself has ratio 1
        hit = near_terms(words.select("token"), terms, least).select("token").distinct()
        counts = words.join(hit.hint("merge"), "token").groupBy("low").agg(F.count("*").cast("int").alias(kind))
        out = out.join(counts.hint("merge"), "low", "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    return out


def scored_attachments(attachments: DataFrame) -> DataFrame:
    """``attachments`` (name, mime, message_type) with score and reason, misspelt words included."""
    hits = name_hits(attachments).hint("merge")
    joined = attachments.withColumn("low", F.lower(F.coalesce("name", F.lit("")))).join(hits, "low")
    score, reason = attachment_score(F.col("name"), F.col("mime"), F.col("message_type"), F.col("negative"), F.col("positive"))
    return joined.withColumns({"score": score, "reason": reason}).drop("low", "negative", "positive")


def attachment_score(name: Column, mime: Column, message_type: Column, negative: Column | None = None, positive: Column | None = None) -> tuple[Column, Column]:
    """(score, reason) of an attachment; only scores over 0 are candidates.

    ``negative`` and ``positive`` count its words for and against; by default only words that are terms themselves.
    """
    low = F.lower(F.coalesce(name, F.lit("")))
    tokens = file_tokens(low)
    negative = _exact(tokens, NEGATIVE) if negative is None else negative
    positive = _exact(tokens, POSITIVE) if positive is None else positive
    quote = F.coalesce(message_type == "orcamento_recebido", F.lit(False))
    ext = F.when(low.rlike(r"\.(pdf|xlsx|xls|csv)$"), 3).when(low.rlike(r"\.(docx|doc)$"), 2).otherwise(0)
    bonus = F.when(low.endswith(".pdf") & F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in PDF_WORDS])), 2).otherwise(0)
    kind = F.when(quote, 3).when(message_type == "pedido_orcamento", -2).otherwise(0)
    total = ext + positive * 3 + bonus + kind
    cases = [
        (~is_budget_file(low), F.lit(-99), "extensao_nao_suportada"),
        (F.lower(F.coalesce(mime, F.lit(""))).startswith("image/"), F.lit(-10), "mime_imagem"),
        (low.rlike("^(" + "|".join(NEGATIVE_PREFIXES) + ")"), F.lit(-10), "prefixo_negativo"),
        ((negative > 0) & (negative >= positive), negative * -3, "sinal_negativo"),
        ((positive == 0) & ~quote, F.lit(-1), "sem_indicio_textual"),
        (total <= 0, total, "baixo_sinal_de_orcamento"),
    ]
    score, reason = F, F
    for test, value, why in cases:
        score, reason = score.when(test, value), reason.when(test, why)
    return score.otherwise(total).cast("int"), reason.otherwise("candidato_valido")


def best_attachment(attachments: DataFrame) -> DataFrame:
    """Each message's best attachment: highest positive score, first on ties.

    If that one is no PDF and has "cota" in its name, the first PDF with "cota" and a positive score goes before it.
    """
    low = F.lower("name")
    message = Window.partitionBy("message_id")
    good = attachments.filter(F.col("score") > 0).withColumn("rank", F.row_number().over(message.orderBy(F.desc("score"), "pos")))
    quoted_pdf = low.endswith(".pdf") & low.contains("cota")
    gives_way = F.max((F.col("rank") == 1) & ~low.endswith(".pdf") & low.contains("cota")).over(message)
    ranked = good.withColumn("over", F.when(gives_way & quoted_pdf, 0).otherwise(1))
    final = F.row_number().over(message.orderBy("over", F.when(F.col("over") == 0, F.col("pos")).otherwise(F.col("rank")), "pos"))
    return ranked.withColumn("n", final).filter("n = 1").drop("rank", "over", "n")


def dedup_attachments(best: DataFrame) -> DataFrame:
    """One row per content and sender, the first to arrive."""
    n = F.row_number().over(Window.partitionBy("sha256", "sender").orderBy("ingest_seq"))
    return best.withColumn("n", n).filter("n = 1").drop("n")


def drop_templates(attachments: DataFrame, institutional: Column) -> DataFrame:
    """Attachments of other senders whose content no institutional sender sent."""
    templates = attachments.filter(institutional).select("sha256").distinct()
    return attachments.filter(~institutional).join(templates, "sha256", "left_anti")


def dispositions(attachments: DataFrame, institutional: Column) -> DataFrame:
    """Each attachment's fate, the first that holds of institutional, template, duplicate, rejected, accepted."""
    own = attachments.withColumn("__inst", institutional)
    templates = own.filter("__inst").select("sha256").distinct().withColumn("__tpl", F.lit(True))
    marked = own.join(templates, "sha256", "left")
    n = F.row_number().over(Window.partitionBy("sha256", "sender").orderBy("ingest_seq"))
    fate = (
        F.when(F.col("__inst"), "institutional").when(F.coalesce("__tpl", F.lit(False)), "template").when(F.col("__n") > 1, "duplicate")
        .when(F.col("score") <= 0, "rejected").otherwise("accepted")
    )
    return marked.withColumn("__n", n).withColumn("disposition", fate).drop("__inst", "__tpl", "__n")
