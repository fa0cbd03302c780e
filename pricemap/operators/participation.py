"""Who was asked, who answered, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricemap.functions.classify import is_institutional
from pricemap.functions.contacts import preferred_name
from pricemap.functions.dates import elapsed_hours
from pricemap.operators.asof import asof_join
from pricemap.operators.enrichment import name_match
from pricemap.work import written

PAIR = ["process_id", "from_email"]


def new_messages(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages that their process hasn't stored, one row per id, the first in arrival order."""
    key = ["process_id", "message_id"]
    fresh = messages.join(stored.select(*key).distinct(), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("ingest_seq"))
    return fresh.withColumn("__n", first).filter("__n = 1").drop("__n")


REPLIES = ("orcamento_recebido", "declinio", "duvida")


def with_quoted_dates(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """Messages with ``quoted_at``: of the dates that one quotes (process_id, message_id, at), the latest up to its own, else the latest."""
    key = ["process_id", "message_id"]
    left = messages.withColumn("at", F.col("sent_at"))
    return asof_join(left, quoted.withColumn("__quoted", F.col("at")), key, "at", "__quoted", "quoted_at", else_latest=True).drop("at")


def participations(messages: DataFrame, exclude_institutional: bool = False) -> DataFrame:
    """Flags and first dates of each sender in a process; "first" is by arrival.

    A request's own date, or the date that a quote, decline or question quotes (``quoted_at``, where the
    messages have it), tells when the request was made; read receipts tell none.
    """
    rows = messages.filter(~is_institutional(F.col("from_email"))) if exclude_institutional else messages
    kind = F.col("type")
    asked_at = F.when(kind == "pedido_orcamento", F.col("sent_at"))
    if "quoted_at" in messages.columns:
        asked_at = asked_at.when(kind.isin(*REPLIES), F.col("quoted_at"))
    replied_at = F.when(kind.isin(*REPLIES), F.col("sent_at"))
    first = lambda at: F.min(F.when(at.isNotNull(), F.struct("ingest_seq", at.alias("at"))))
    out = rows.groupBy(*PAIR).agg(
        F.max(kind == "pedido_orcamento").alias("asked"),
        F.max(kind == "orcamento_recebido").alias("sent_quote"),
        F.max(kind == "declinio").alias("declined"),
        F.max(kind == "confirmacao_leitura").alias("read_ok"),
        first(asked_at).alias("r"),
        first(replied_at).alias("a"),
    )
    return out.select(*PAIR, "asked", "sent_quote", "declined", "read_ok", F.col("r.at").alias("requested_at"), F.col("a.at").alias("first_reply_at"))


def type_distribution(messages: DataFrame) -> DataFrame:
    """Messages of each type, most first; a missing type is ``outro``."""
    return messages.groupBy(F.coalesce("type", F.lit("outro")).alias("type")).agg(F.count("*").alias("n_messages")).orderBy(F.desc("n_messages"), "type")


def supplier_stats(suppliers: DataFrame, part: DataFrame) -> DataFrame:
    """Each supplier's processes and totals of its flags; null sums without a participation."""
    own = part.groupBy("from_email").agg(
        F.countDistinct("process_id").alias("n"),
        *[F.sum(F.col(c).cast("long")).alias(c) for c in ("sent_quote", "declined", "read_ok")],
    )
    joined = suppliers.join(own, "from_email", "left")
    return joined.select("from_email", F.coalesce("n", F.lit(0)).alias("n_processes"), F.col("sent_quote").alias("quotes"), F.col("declined").alias("declines"), F.col("read_ok").alias("reads"))


def process_suppliers(suppliers: DataFrame, part: DataFrame) -> DataFrame:
    """Participations with the supplier's preferred name, in name order."""
    named = part.join(suppliers, "from_email").withColumn("name", preferred_name(F.col("from_email"), F.col("name")))
    return named.orderBy("process_id", F.lower("name"), "from_email")


def process_summary(messages: DataFrame, part: DataFrame) -> DataFrame:
    """Counts of a process and its mean response time in hours over non-negative spans."""
    counts = messages.groupBy("process_id").agg(F.count("*").alias("n_messages"))
    hours = elapsed_hours(F.col("requested_at"), F.col("first_reply_at"))
    silent = ~F.col("sent_quote") & ~F.col("declined") & ~F.col("read_ok") & F.col("first_reply_at").isNull()
    own = part.groupBy("process_id").agg(
        F.count("*").alias("n_suppliers"), F.count_if("sent_quote").alias("n_sent"), F.count_if("declined").alias("n_declined"),
        F.count_if("read_ok").alias("n_read"), F.count_if(silent).alias("n_silent"), F.round(F.avg(F.when(hours >= 0, hours)), 4).alias("mean_hours"),
    )
    return counts.join(own, "process_id", "left")


def status_counts(part: DataFrame) -> DataFrame:
    """Suppliers of a process by status; any reply implies that the request was read."""
    read = F.col("read_ok") | F.col("sent_quote") | F.col("declined") | F.col("first_reply_at").isNotNull()
    return part.groupBy("process_id").agg(
        F.count("*").alias("n_suppliers"), F.count_if("sent_quote").alias("n_quotes"), F.count_if("declined").alias("n_declined"),
        F.count_if(read).alias("n_read_effective"), F.count_if(~read).alias("n_unread"),
    )


def participation_status(part: DataFrame) -> DataFrame:
    """The first that holds of quote, decline, question, read, none."""
    status = (
        F.when(F.col("sent_quote"), "orcamento_recebido").when(F.col("declined"), "declinio").when(F.col("first_reply_at").isNotNull(), "duvida")
        .when(F.col("read_ok"), "confirmacao_leitura").otherwise("sem_resposta")
    )
    return part.withColumn("status", status)


def response_rate(part: DataFrame) -> DataFrame:
    """Share of a process' suppliers that answered."""
    return part.groupBy("process_id").agg(
        F.count("*").alias("n_contacted"), F.count("first_reply_at").alias("n_answered"), F.round(F.try_divide(F.count("first_reply_at"), F.count("*")), 6).alias("response_rate")
    )


def items_per_supplier(links: DataFrame, items: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Items of the files that each sender is linked to; senders without a supplier row appear too (J14, mail path)."""
    counts = links.join(items.groupBy("process_id", "file_id").agg(F.count("*").alias("n")), ["process_id", "file_id"])
    own = counts.groupBy("process_id", F.col("sender_email").alias("email")).agg(F.sum("n").alias("n_items"), F.countDistinct("file_id").alias("n_files"))
    joined = suppliers.select("process_id", "email").join(own, ["process_id", "email"], "full_outer")
    return joined.select("process_id", "email", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def items_per_supplier_by_name(links: DataFrame, items: DataFrame, suppliers: DataFrame, documents: DataFrame) -> DataFrame:
    """Items of each supplier of a process, by mail or else by company.

    Links with a sender count for its address.  The files of the others count for every supplier
    (process_id, email, name) whose name is likely that of the file's company (``documents``: file_id, supplier).  Senders with items
    but no supplier row appear too; suppliers without items have zero.  ``items`` may be counts already (process_id, file_id, n).
    """
    mail = F.lower(F.trim(F.coalesce("sender_email", F.lit(""))))
    counts = items if "n" in items.columns else items.groupBy("process_id", "file_id").agg(F.count("*").alias("n"))
    linked = links.select("process_id", "file_id", mail.alias("email")).join(counts.hint("merge"), ["process_id", "file_id"])
    by_mail = linked.filter("email <> ''").groupBy("process_id", "email").agg(F.sum("n").alias("by_mail"))
    company = F.trim(F.coalesce("supplier", F.lit("")))
    owned = linked.filter("email = ''").join(documents.select("file_id", company.alias("company")).hint("merge"), "file_id").filter("company <> ''")
    owned = written(owned.groupBy("process_id", "company").agg(F.sum("n").alias("n")), "company-items")
    known = suppliers.select("process_id", F.lower(F.trim("email")).alias("email"), F.trim(F.coalesce("name", F.lit(""))).alias("name")).filter("email <> ''").distinct()
    names, companies = known.select("name", F.col("name").alias("of_name")).distinct(), owned.select(F.col("company").alias("name"), "company").distinct()
    alike = written(name_match(names, companies, "of_name", "company").select("of_name", "company"), "company-names")
    met = known.join(alike.hint("merge"), known["name"] == alike["of_name"]).join(owned.hint("merge"), ["process_id", "company"])
    by_name = met.groupBy("process_id", "email").agg(F.sum("n").alias("by_name"))
    out = known.select("process_id", "email").distinct().join(by_mail.hint("merge"), ["process_id", "email"], "full_outer").join(by_name.hint("merge"), ["process_id", "email"], "left")
    return out.select("process_id", "email", (F.coalesce("by_mail", F.lit(0)) + F.coalesce("by_name", F.lit(0))).alias("n_items"))


def backfill_sender(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Links whose sender is blank take it from the message that their file id names."""
    wanted = F.when((F.trim(F.coalesce("sender_email", F.lit(""))) == "") & F.col("file_id").startswith("email_attachment:"), F.regexp_extract("file_id", r"^email_attachment:([^:]*):", 1))
    senders = messages.groupBy(F.col("process_id").alias("__p"), F.col("message_id").alias("__m")).agg(F.min_by("from_email", "ingest_seq").alias("__from"))
    marked = links.withColumn("__want", wanted)
    joined = marked.join(senders, (F.col("process_id") == F.col("__p")) & (F.col("__want") == F.col("__m")), "left")
    return joined.withColumn("sender_email", F.coalesce("__from", "sender_email")).drop("__want", "__p", "__m", "__from")
