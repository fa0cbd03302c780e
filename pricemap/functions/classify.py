"""Rules that classify messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What messages of each type say.
RECEIPT_SUBJECTS = ["lida:", "lido:", "confirmação de leitura", "read receipt", "delivery notification", "entregue:", "recebida:"]
REQUEST_WORDS = ["orçamento", "cotação", "cotacao", "proposta", "solicita"]
DECLINE_WORDS = [
    "não podemos", "nao podemos", "impossibilitados", "sem condições", "sem condicoes", "declino", "declínio", "não participar",
    "nao participar", "não enviaremos", "nao enviaremos", "desculpe", "lamentamos",
]
QUOTE_WORDS = [
    "proposta de preços", "proposta de precos", "nossa proposta", "segue proposta", "segue cotação", "segue cotacao", "conforme solicitado",
    "valor unitário", "valor unitario", "preço unitário", "preco unitario", "r$/un", "r$/pct", "nossa cotação", "nossa cotacao",
]
QUESTION_WORDS = [
    "gostaria de esclarecimento", "poderia esclarecer", "qual a especificação", "qual a especificacao", "o que é o item", "o que e o item",
    "pode detalhar", "poderia detalhar", "prazo de entrega", "em qual cidade", "local de entrega", "pergunta sobre",
]
# Display names of the types.
TYPE_LABELS = {
    "pedido_orcamento": "Pedido de Orçamento", "orcamento_recebido": "Orçamento Recebido", "confirmacao_leitura": "Confirmação de Leitura",
    "declinio": "Declínio", "duvida": "Dúvida", "tramite_interno": "Trâmite Interno", "outro": "Outro",
}


def _says(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def is_institutional(email: Column, suffix: str = ".mil.br", extra: list[str] | None = None) -> Column:
    """Whether an address belongs to the buying institution (F2)."""
    own = F.lower(F.coalesce(email, F.lit("")))
    return own.endswith(suffix) | own.isin(extra or [])


def classify_rules(subject: Column, body: Column, sender: Column, is_mdn: Column, extra: list[str] | None = None) -> Column:
    """Type of a message by the first rule that holds, null if none does; the body counts up to 1500 characters."""
    subject = F.lower(F.coalesce(subject, F.lit("")))
    body = F.substring(F.lower(F.coalesce(body, F.lit(""))), 1, 1500)
    return (
        F.when(F.coalesce(is_mdn, F.lit(False)) | _says(subject, RECEIPT_SUBJECTS), "confirmacao_leitura")
        .when(is_institutional(sender, extra=extra) & _says(F.concat(subject, body), REQUEST_WORDS), "pedido_orcamento")
        .when(_says(body, DECLINE_WORDS), "declinio")
        .when(_says(body, QUOTE_WORDS), "orcamento_recebido")
        .when(_says(body, QUESTION_WORDS), "duvida")
    )


def apply_labels(messages: DataFrame, labels: DataFrame, rules_only: bool = False) -> DataFrame:
    """Type, confidence and summary of every message: the rules' label, else the outside one, else ``outro``.

    ``messages`` has ``rule_type``; ``labels`` has message_id, type, confidence, summary.
    """
    given = labels.select(F.col("message_id").alias("__id"), F.col("type").alias("__type"), F.col("confidence").alias("__conf"), "summary")
    joined = messages.join(given, messages["message_id"] == given["__id"], "left")
    return joined.withColumns(
        {
            "type": F.coalesce("rule_type", "__type", F.lit("outro")),
            "confidence": F.when(F.col("rule_type").isNotNull(), F.lit(80 if rules_only else 90)).otherwise(F.coalesce("__conf", F.lit(0))),
        }
    ).drop("__id", "__type", "__conf")


def type_label(col: Column) -> Column:
    """Display name of a type; unknown ones as they are."""
    pairs = [x for k, v in TYPE_LABELS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[col], col)


def process_number(subject: Column) -> Column:
    """Number of a tender in a subject, by four patterns in order."""
    # The patterns.
    patterns = [
        r"\b(\d{5,6}\.\d{5,6}/\d{4}-\d{2})\b",
        r"(?i)(?:Preg[aãAÃ]o|Tomada\s+de\s+Pre[cçÇ]os?|TP|RDC|Concorr[eêÊ]ncia|Ades[aãÃ]o|Dispensa|Inexigibilidade)[^\d]{0,15}(\d{1,4}[./]\d{4})",
        r"(?i)(?:Processo|Proc\.?)\s*([\w.\-]{3,30}/\d{4})",
        r"\b(\d{1,4}/\d{4})\b",
    ]
    found = [F.regexp_extract(subject, p, 1) for p in patterns]
    return F.coalesce(*[F.when(x != "", F.trim(x)) for x in found])
