"""Binding of the marketplace tables to the given Parquet tables.

The marketplace's own data are not available, so each of its tables is
*derived* from one of the given tables by fixed column expressions.  The
same expressions are written as SQL in ``marketframe.plans.oracle`` so that
an independent engine can check every query.  All derivations are
row-wise projections (no shuffles) except where a table is a fold of a
change log.

Fixed values of the binding (chosen by us, not taken from anywhere):
cards <- part, sellers <- supplier, inventory change lines <- lineitem,
users <- customer, roles <- distinct (o_custkey, o_orderpriority) of orders,
tournaments <- supplier, join requests <- customer, login attempts <- events.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.functions.semantics import ntz_lit
from marketframe.schemas import MONEY
from marketframe.sources.tables import read_table

# Fixed values of the binding.
CUTOFF = _dt.datetime(1998, 1, 1)          # base inventory = lines shipped before
NOW = _dt.datetime(2002, 1, 1)             # the "current time" parameter of DML queries
SELLER_EPOCH = _dt.datetime(2023, 1, 1)    # sellers' created_at origin
LANDED_CARDS = 100_000                     # cards of one landed feed document
LOCK_EPOCH = _dt.datetime(2024, 1, 1, 6)   # initial lock of some sellers


def _s(c: Column) -> Column:
    return c.cast("string")


def _dni(key: Column) -> Column:
    """The key as text of eight digits or more (never cut)."""
    text = _s(key)
    return F.when(F.length(text) > 8, text).otherwise(F.lpad(text, 8, "0"))


def share(table: DataFrame, over: int, under: int) -> int:
    """``over / under`` of a table's rows, at least 1: how many different keys
    its requests draw from, so collisions stay as frequent at every scale.
    The count comes from the Parquet footers."""
    return max(1, table.count() * over // under)


def _ts(value: _dt.datetime) -> Column:
    return ntz_lit(value)


# ---- catalog ----------------------------------------------------------------
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("type"),
        F.concat(F.col("p_type"), F.lit(" Card")).alias("human_readable_card_type"),
        F.lower("p_type").alias("frame_type"),
        F.concat_ws(" ", "p_name", F.lit("from"), "p_brand").alias("description"),
        F.when(size % 3 == 0, "Dragon").when(size % 3 == 1, "Spellcaster")
         .otherwise("Warrior").alias("race"),
        (size * 100).cast("int").alias("atk"),
        F.when(size % 5 != 0, (50 - size) * 100).cast("int").alias("def"),
        size.alias("level"),
        F.when(size % 4 == 0, "DARK").when(size % 4 == 1, "LIGHT")
         .when(size % 4 == 2, "EARTH").alias("attribute"),
        F.col("p_brand").alias("archetype"),
        F.concat(F.lit("card-"), _s(F.col("p_partkey"))).alias("ygoprodeck_url"),
    )


def feed(spark: SparkSession, sf_dir: str, since: _dt.datetime | None = None) -> DataFrame:
    """The nested catalog feed as it would land: one row per card with child
    arrays.  ``card_sets`` holds one entry per (return flag, line status)
    pair that occurs in the card's lines, so it has at most six elements and
    is built after a map-side pre-aggregation (a hot card cannot make a
    huge array).  With ``since`` the feed is a later delivery: only lines
    shipped from then on make sets, and only cards with such sets appear."""
    li = read_table(spark, sf_dir, "lineitem", spread=True)
    if since is not None:
        li = li.where(F.col("l_shipdate") >= ntz_lit(since))
    sets = (li.groupBy("l_partkey", "l_returnflag", "l_linestatus")
              .agg(F.min("l_extendedprice").alias("low")))
    price = _s(F.col("low").cast(MONEY))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    sets = sets.select(
        "l_partkey",
        F.struct(
            F.concat(F.lit("SET-"), flag).alias("set_name"),
            F.concat(flag, status).alias("set_code"),
            F.when(status == "O", "Common").otherwise("Rare").alias("set_rarity"),
            F.when(flag == "N", "").otherwise(F.concat(F.lit("("), flag, F.lit(")")))
             .alias("set_rarity_code"),
            F.when(flag == "A", price)
             .when(flag == "R", F.concat(price, F.lit("usd")))
             .when(status == "O", F.lit(""))
             .otherwise(F.lit("n/a")).alias("set_price"),
        ).alias("s"))
    sets = sets.groupBy("l_partkey").agg(F.collect_list("s").alias("card_sets"))

    p = read_table(spark, sf_dir, "part")
    c = cards(spark, sf_dir)
    size = F.col("p_size")
    retail = _s(F.col("p_retailprice").cast(MONEY))
    extra = p.select(
        F.col("p_partkey").alias("pk"),
        F.when(size % 7 == 0, F.lit(None).cast("array<string>"))
         .when(size % 7 == 1, F.array().cast("array<string>"))
         .otherwise(F.array("p_type", F.when(size % 2 == 0, "Effect").otherwise("Normal"),
                            "p_type")).alias("typeline"),
        F.when(size % 6 == 0, F.struct(F.lit("Banned").alias("ban_ocg")))
         .when(size % 6 == 1, F.struct(F.lit(None).cast("string").alias("ban_ocg")))
         .alias("banlist_info"),
        F.array(F.struct(
            F.concat(F.lit("img/"), _s(F.col("p_partkey"))).alias("image_url"),
            F.when(size % 2 == 0, "").otherwise(F.concat(F.lit("img/s/"), _s(F.col("p_partkey"))))
             .alias("image_url_small"),
            F.when(size % 3 == 0, F.concat(F.lit("img/c/"), _s(F.col("p_partkey"))))
             .alias("image_url_cropped"))).alias("card_images"),
        F.when(size % 8 != 0, F.array(F.struct(
            retail.alias("cardmarket_price"),
            F.concat(retail, F.lit("$")).alias("tcgplayer_price"),
            F.lit("").alias("ebay_price"),
            F.when(size % 2 == 0, F.lit("1,234")).otherwise(F.lit(None)).alias("amazon_price"),
            F.lit("abc").alias("coolstuffinc_price")))).alias("card_prices"),
    )
    out = (c.join(extra, c.id == extra.pk, "inner")
            .join(sets, c.id == sets.l_partkey, "left" if since is None else "inner"))
    return out.select(
        "id", "name", "type", F.col("human_readable_card_type").alias("humanReadableCardType"),
        F.col("frame_type").alias("frameType"), F.col("description").alias("desc"), "race",
        "atk", "def", "level", "attribute", "archetype", "ygoprodeck_url", "typeline",
        "card_sets", "banlist_info", "card_images", "card_prices")


def land_feed(cards: DataFrame, path: str) -> None:
    """Feed rows as landed JSON documents ``{"data": [card, ...]}`` under
    ``path``, one file for each ``LANDED_CARDS`` consecutive card ids."""
    rows = cards.select(F.floor(F.col("id") / LANDED_CARDS).alias("document"), "id",
                        F.to_json(F.struct(*cards.columns)).alias("value"))
    ends = rows.groupBy("document").agg(F.max("id").alias("last"))
    lines = (rows.join(ends, "document")
                 .select("document", F.lit(1).alias("part"), "id",
                         F.concat("value", F.when(F.col("id") < F.col("last"), ",").otherwise("")).alias("value")))
    for part, text in ((0, '{"data": ['), (2, "]}")):
        lines = lines.unionByName(ends.select("document", F.lit(part).alias("part"), F.lit(0).cast("long").alias("id"),
                                              F.lit(text).alias("value")))
    (lines.repartition("document").sortWithinPartitions("document", "part", "id")
          .select("document", "value").write.partitionBy("document").text(path))


# ---- sellers and inventory ----------------------------------------------------
def vendedores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("vendedor_id"),
        F.col("s_name").alias("nombres"),
        F.concat(F.lit("Nation"), _s(F.col("s_nationkey"))).alias("apellidos"),
        F.concat(F.lit("seller"), _s(key), F.lit("@mail.test")).alias("correo"),
        F.concat(F.lit("hash"), _s(key)).alias("password_hash"),
        _dni(key).alias("dni"),
        F.when(key % 7 != 3, F.concat(F.lit("KID"), _s(key))).alias("konami_id"),
        F.when(key % 2 == 0, F.concat(F.lit("+51"), _s(key))).alias("whatsapp"),
        F.when(key % 3 == 0, F.concat(F.lit("@s"), _s(key))).alias("instagram"),
        F.lit(None).cast("string").alias("facebook"),
        F.lit(None).cast("string").alias("otro"),
        (key % 3).cast("int").alias("intentos_fallidos"),
        F.when(key % 10 == 0, _ts(LOCK_EPOCH)).alias("bloqueado_hasta"),
        F.lit(None).cast("timestamp_ntz").alias("ultimo_login"),
        (_ts(SELLER_EPOCH) + F.make_dt_interval(F.lit(0), (key * 37) % 1000)).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
        (F.col("s_acctbal") > 0).alias("activo"),
        (key % 4 == 0).alias("email_verificado"),
    )


ARRIVAL_COLUMNS = ("at", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                   "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def inventory_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Inventory change lines (add / bulk add requests) from lineitem.

    ``seq`` is the arrival order: a struct of every lineitem column, ship
    date first (no two lineitem rows are equal, so it is a total order).  It
    is compared, never numbered, so no window or single task is needed.

    ``dealt``: as ``fold_additive_lines`` wants them, with ``inventario_id``.
    The stored rows are shuffled and sorted; a line holds their values twice.
    """
    li = read_table(spark, sf_dir, "lineitem", spread=True)
    if dealt:
        from marketframe.operators.changes import inventory_id
        li = li.withColumn("inventario_id", inventory_id(F.col("l_suppkey"), F.col("l_partkey")))
        key = ["inventario_id", "l_suppkey"]
        li = li.repartition(*key).sortWithinPartitions(*key, "l_partkey")
    q, tax, disc = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    lines = li.select(
        F.col("l_suppkey").alias("vendedor_id"),
        F.col("l_partkey").alias("card_id"),
        F.when(q == 50, 0).otherwise(q.cast("int")).alias("cantidad"),
        F.when(tax == 0, F.lit(None).cast(MONEY)).when(disc == 0, F.lit(0).cast(MONEY))
         .otherwise(F.col("l_extendedprice").cast(MONEY)).alias("precio"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("condicion"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("idioma"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("ED"), _s(F.col("l_linenumber"))))
         .alias("edicion"),
        F.when(disc >= 0.05, F.concat(F.lit("orden "), _s(F.col("l_orderkey")))).alias("notas"),
        F.col("l_shipdate").alias("at"),
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", *(["inventario_id"] if dealt else []),
    )
    return lines.select(
        F.struct(*ARRIVAL_COLUMNS).alias("seq"),
        "vendedor_id", "card_id", "cantidad", "precio", "condicion", "idioma", "edicion",
        "notas", "at", *(["inventario_id"] if dealt else []))


def inventario(spark: SparkSession, sf_dir: str, before: _dt.datetime | None = None) -> DataFrame:
    """The stored inventory: every change line applied in arrival order to an
    empty table with the single-add rule, each request stamped with its own
    time.  ``before`` keeps only lines that arrived before that time."""
    from marketframe.operators.changes import fold_additive_lines, valid_lines
    lines, _ = valid_lines(inventory_lines(spark, sf_dir, dealt=True))
    if before is not None:
        lines = lines.where(F.col("at") < ntz_lit(before))
    return fold_additive_lines(lines, time_col="at", dealt=True)


# ---- users, roles -------------------------------------------------------------
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"),
        F.col("c_name").alias("username"),
        F.concat(F.lit("hash"), _s(key)).alias("password_hash"),
        F.concat(F.lit("p"), _s(key), F.lit("@mail.test")).alias("email"),
        _dni(key).alias("dni"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "vendedor")
         .otherwise("cliente").alias("user_type"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        (_ts(SELLER_EPOCH) + F.make_dt_interval(key % 365)).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def user_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, role) pairs from orders; the priority picks the role."""
    o = read_table(spark, sf_dir, "orders", spread=True)
    role = (F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "vendedor")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "admin")
             .otherwise("cliente"))
    return o.select(F.col("o_custkey").alias("user_id"), role.alias("role")).distinct()


def user_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of user registration requests (one per order).  Some reuse the
    e-mail or dni of the stored user who placed the order; the others draw
    from key ranges that only collide inside the batch."""
    o = read_table(spark, sf_dir, "orders", spread=True)
    key = F.col("o_orderkey")
    pr = F.col("o_orderpriority")
    return o.select(
        key.alias("seq"),
        F.when(key % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("player"), _s(key % share(o, 1, 3))))
         .alias("username"),
        F.substring(F.lit("secretpassword"), 1, (key % 12).cast("int")).alias("password"),
        F.when(key % 10 == 0, F.lit("bad-email"))
         .when(key % 10 == 1, F.lit("with space@mail.test"))
         .when(key % 11 == 0, F.concat(F.lit("p"), _s(F.col("o_custkey")), F.lit("@mail.test")))
         .otherwise(F.concat(F.lit("r"), _s(key % share(o, 4, 3)), F.lit("@mail.test"))).alias("email"),
        F.when(key % 13 == 0, _dni(F.col("o_custkey")))
         .otherwise(F.concat(F.lit("R"), _s(key % share(o, 7, 15)))).alias("dni"),
        F.when(pr == "1-URGENT", "vendedor").when(pr == "2-HIGH", "cliente")
         .when(pr == "4-NOT SPECIFIED", "admin").when(pr == "5-LOW", "")
         .alias("user_type"),
    )


def seller_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of seller registration requests (one per customer)."""
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("seq"),
        F.when(key % 11 == 0, F.lit("")).otherwise(F.col("c_name")).alias("nombres"),
        F.col("c_mktsegment").alias("apellidos"),
        F.when(key % 13 != 0, F.concat(F.lit("Seller"), _s(key % share(c, 2, 3)), F.lit("@Mail.Test")))
         .alias("correo"),
        F.substring(F.lit("contrasena-segura"), 1, (key % 14).cast("int")).alias("password"),
        _dni(key % share(c, 4, 5)).alias("dni"),
        F.when(F.col("c_nationkey") % 4 != 0, F.concat(F.lit("KID"), _s(key % share(c, 1, 3))))
         .alias("konami_id"),
        F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("+51"), _s(key))).otherwise(F.lit(""))
         .alias("whatsapp"),
        F.when(key % 5 == 0, F.concat(F.lit("@c"), _s(key))).alias("instagram"),
        F.lit(None).cast("string").alias("facebook"),
        F.when(key % 9 == 0, F.lit("")).alias("otro"),
    )


# ---- tournaments -------------------------------------------------------------
def tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tournament per supplier (grows with the data); some have a NULL
    stored count and one in eleven has an unparsable capacity."""
    t = read_table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return t.select(
        key.alias("id"),
        F.concat(F.lit("Torneo "), F.col("s_name")).alias("name"),
        F.when(key % 5 != 0, (key % 4) * 5).cast("int").alias("participants"),
        F.when(key % 11 == 7, F.lit("sin limite"))
         .otherwise(_s(20 + (key % 3) * 20)).alias("maxPlayers"),
    )


def crowded(spark: SparkSession, sf_dir: str) -> int:
    """Join requests and results name one of the first 37 in 100 tournaments,
    so every scale has crowded tournaments and all outcomes occur."""
    return share(read_table(spark, sf_dir, "supplier"), 37, 100)


def stored_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players of earlier join requests, one a customer; some have results."""
    c = read_table(spark, sf_dir, "customer")
    key, span = F.col("c_custkey"), crowded(spark, sf_dir)
    return c.select(F.col("c_name").alias("name"), F.concat(F.lit("KID"), _s(key)).alias("konamiid"),
                    (key * 7 % span).cast("long").alias("idtournament"),
                    F.when(key % 3 == 0, key % 4).cast("int").alias("victory"),
                    F.when(key % 3 == 0, key % 2).cast("int").alias("defeat"), F.lit(None).cast("int").alias("draw"))


def tournament_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Join requests in arrival order ``seq`` (one per customer); every 50th
    names a tournament that does not exist."""
    c = read_table(spark, sf_dir, "customer")
    key, span = F.col("c_custkey"), crowded(spark, sf_dir)
    return c.select(
        key.alias("seq"),
        F.concat(F.lit("KID"), _s(key)).alias("konamiid"),
        F.col("c_name").alias("name"),
        F.when(key % 50 == 49, -1 - key).otherwise(key % span)
         .cast("long").alias("idtournament"),
    )


def tournament_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result updates for players; some name no stored player."""
    c = read_table(spark, sf_dir, "customer")
    key, span = F.col("c_custkey"), crowded(spark, sf_dir)
    return (c.select(
        F.concat(F.lit("KID"), _s(key)).alias("konamiid"),
        F.when(key % 7 == 0, key % span + 1).otherwise(key % span)
         .cast("long").alias("idtournament"),
        (key % 5).cast("int").alias("victory"),
        (key % 4).cast("int").alias("defeat"),
        F.when(key % 6 != 0, key % 2).cast("int").alias("draw"),
    ))


# ---- login attempts ----------------------------------------------------------
def login_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", spread=True)
    return e.select(
        F.col("user_id").alias("account_id"),
        F.col("ts").alias("at"),
        (~F.col("event_type").isin("error", "view", "click")).alias("password_ok"),
    )


# ---- searches ----------------------------------------------------------------
def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests, one a nation: a stretch of the name of some card, in
    other case, with wildcards or short; one is blank.  Some carry filters."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("request_id"))
    p = read_table(spark, sf_dir, "part").select(((F.col("p_partkey") - 1) / 3).alias("request_id"),
                                                 F.col("p_name").alias("name"))
    k, name = F.col("request_id"), F.col("name")
    text = (F.when(k == 24, F.lit("  ")).when(k % 6 == 0, F.upper(F.substring(name, 2, 4)))
             .when(k % 6 == 1, F.substring(name, 1, 2)).when(k % 6 == 2, F.replace(F.substring(name, 1, 5), F.lit("e"), F.lit("_")))
             .when(k % 6 == 3, F.concat(F.substring(name, 1, 2), F.lit("%"), F.substring(name, -2, 2)))
             .when(k % 6 == 4, F.substring(name, 3, 1)).otherwise(name))
    return n.join(p, "request_id").select(
        "request_id", text.alias("text"), F.when(k % 3 == 1, "R").when(k % 3 == 2, "").alias("condicion"),
        F.when(k % 4 == 1, "F").alias("idioma"), F.when(k % 5 != 2, (k + 1) * 4000.0).alias("precio_max"))


# ---- bulk requests -----------------------------------------------------------
def bulk_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-add requests, one an order, with its lines as the array ``cartas``.
    Some arrays are missing or empty, some lines name no card."""
    li = read_table(spark, sf_dir, "lineitem", spread=True)
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        *order, "l_returnflag", "l_linestatus"))).alias("lines"))

    def item(x):
        return F.struct(
            F.when(x["l_quantity"] == 25, 0).when(x["l_linenumber"] % 4 != 0, x["l_partkey"]).cast("long").alias("card_id"),
            F.when(x["l_quantity"] != 50, x["l_quantity"]).cast("int").alias("cantidad"),
            x["l_extendedprice"].cast(MONEY).alias("precio"), x["l_returnflag"].alias("condicion"),
            F.lit("").alias("idioma"), x["l_linestatus"].alias("edicion"), F.lit(None).cast("string").alias("notas"))
    o = read_table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    items = F.transform(F.coalesce("lines", F.array()), item)
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("vendedor_id"),
                    F.when(F.col("o_orderkey") % 10 != 1, items).alias("cartas"))
