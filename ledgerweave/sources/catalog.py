"""The canonical field catalog of each entity."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    tag: str | None
    dtype: str
    synonyms: list[str] = field(default_factory=list)
    required: bool = False
    unique: bool = False
    value_set: str | None = None
    example: str | None = None
    enum_values: list[str] | None = None
    regex: str | None = None


# The fields of every entity, in catalog order.
UNIT = [
    Field("name", "Unit Symbol", "NAME", "string", ["unit", "uom", "symbol", "unit name", "unit of measure"],
          required=True, unique=True, example="Pcs"),
    Field("is_simple", "Simple Unit?", "ISSIMPLEUNIT", "bool", ["simple", "is simple"], example="Yes"),
    Field("decimal_places", "Decimal Places", "DECIMALPLACES", "integer", ["decimals", "decimal places", "precision"],
          example="0"),
    Field("base_units", "Base Unit (compound)", "BASEUNITS", "unit_ref", ["base unit", "base"], value_set="units",
          example="Pcs"),
    Field("additional_units", "Additional Unit (compound)", "ADDITIONALUNITS", "unit_ref",
          ["additional unit", "secondary unit"], value_set="units", example="Box"),
    Field("conversion", "Conversion (compound)", "CONVERSION", "decimal", ["conversion", "factor", "ratio"],
          example="12"),
]
GROUP = [
    Field("name", "Group Name", "NAME", "string", ["group", "group name", "account group"], required=True, unique=True,
          example="Trade Debtors"),
    Field("parent", "Under (Parent Group)", "PARENT", "group_ref", ["under", "parent", "parent group", "primary"],
          required=True, value_set="groups", example="Sundry Debtors"),
    Field("is_revenue", "Is Revenue (P&L)?", "ISREVENUE", "bool", ["revenue", "p&l", "profit and loss"], example="No"),
    Field("is_deemed_positive", "Debit Nature?", "ISDEEMEDPOSITIVE", "bool", ["nature", "dr nature", "debit nature"],
          example="Yes"),
    Field("is_billwise", "Maintain Bill-wise?", "ISBILLWISEON", "bool", ["bill wise", "billwise", "maintain bill-wise"],
          example="Yes"),
    Field("affects_gross_profit", "Affects Gross Profit?", "AFFECTSGROSSPROFIT", "bool",
          ["gross profit", "affects gross profit"], example="No"),
]
STOCK_ITEM = [
    Field("name", "Item Name", "NAME", "string", ["item", "product", "stock item", "sku", "item name"], required=True,
          unique=True, example="Red Striped Shirt"),
    Field("parent", "Under (Stock Group)", "PARENT", "group_ref", ["stock group", "category", "group", "under"],
          value_set="stock_groups", example="Apparel"),
    Field("base_units", "Base Units", "BASEUNITS", "unit_ref", ["unit", "uom", "units", "base unit"], required=True,
          value_set="units", example="Pcs"),
    Field("category", "Category", "CATEGORY", "string", ["category"], example="Shirts"),
    Field("description", "Description", "DESCRIPTION", "string", ["description", "desc"],
          example="Cotton red striped formal shirt"),
    Field("opening_qty", "Opening Quantity", "OPENINGBALANCE", "decimal",
          ["opening qty", "opening stock", "qty", "quantity"], example="25"),
    Field("opening_rate", "Opening Rate", "OPENINGRATE", "decimal", ["rate", "opening rate", "cost"], example="490.00"),
    Field("opening_value", "Opening Value", "OPENINGVALUE", "decimal", ["opening value", "value"], example="12250.00"),
    Field("hsn", "HSN Code", "HSNCODE", "string", ["hsn", "hsn code", "sac"], regex=r"^[0-9]{4,8}$", example="61052010"),
    Field("gst_rate", "GST Rate (%)", None, "decimal", ["gst %", "tax rate", "gst rate", "igst"], example="5"),
    Field("gst_applicable", "GST Applicable?", "GSTAPPLICABLE", "bool", ["gst applicable", "taxable"], example="Yes"),
]
LEDGER = [
    Field("name", "Ledger Name", "NAME", "string",
          ["ledger", "account", "party", "account name", "ledger name", "party name"], required=True, unique=True,
          example="Customer ABC"),
    Field("parent", "Under (Group)", "PARENT", "group_ref", ["under", "group", "head", "account group", "ledger group"],
          required=True, value_set="groups", example="Sundry Debtors"),
    Field("opening_balance", "Opening Balance", "OPENINGBALANCE", "amount",
          ["opening", "ob", "balance", "opening bal", "opening balance"], example="15000.00"),
    Field("opening_balance_drcr", "Opening Dr/Cr", None, "enum", ["dr/cr", "type", "balance type", "dr cr"],
          example="Cr", enum_values=["Dr", "Cr"]),
    Field("gst_registration_type", "GST Registration Type", "GSTREGISTRATIONTYPE", "enum",
          ["gst type", "registration type", "gst reg"], example="Regular",
          enum_values=["Regular", "Composition", "Unregistered", "Unknown", "Consumer"]),
    Field("gstin", "GSTIN", "PARTYGSTIN", "string", ["gstin", "gst no", "gst number", "tax id"],
          regex=r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$", example="29ABCDE1234F1Z5"),
    Field("pan", "PAN", "INCOMETAXNUMBER", "string", ["pan", "pan no", "income tax no"],
          regex=r"^[A-Z]{5}[0-9]{4}[A-Z]$", example="ABCDE1234F"),
    Field("state", "State", "LEDSTATENAME", "enum", ["state", "lstate"], value_set="states", example="Karnataka"),
    Field("country", "Country", "COUNTRYNAME", "string", ["country"], example="India"),
    Field("is_billwise", "Maintain Bill-wise?", "ISBILLWISEON", "bool", ["bill wise", "billwise", "maintain bill-wise"],
          example="Yes"),
    Field("mailing_name", "Mailing Name", "MAILINGNAME", "string", ["mailing name", "display name"],
          example="Customer ABC"),
    Field("address", "Address", "ADDRESS", "string", ["address", "addr"], example="Door No 123, Main Lane"),
    Field("pincode", "Pincode", "PINCODE", "string", ["pincode", "pin", "zip"], regex=r"^[0-9]{6}$", example="560068"),
    Field("email", "Email", "EMAIL", "string", ["email", "e-mail"], regex=r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
          example="abc@company.com"),
    Field("phone", "Phone", "LEDGERPHONE", "string", ["phone", "contact", "mobile", "tel"], example="08888888888"),
    Field("credit_limit", "Credit Limit", "CREDITLIMIT", "decimal", ["credit limit", "limit"], example="100000"),
]
VOUCHER = [
    Field("voucher_number", "Voucher No.", "VOUCHERNUMBER", "string",
          ["voucher no", "vch no", "voucher number", "invoice no", "invoice number", "bill no", "document no", "doc no",
           "ref no", "reference", "number", "txn id", "transaction id", "id"], required=True, example="INV-001"),
    Field("date", "Date", "DATE", "date",
          ["date", "voucher date", "transaction date", "txn date", "invoice date", "bill date", "entry date"],
          required=True, example="2026-04-01"),
    Field("voucher_type", "Voucher Type", "VOUCHERTYPENAME", "string",
          ["voucher type", "vch type", "type", "transaction type", "entry type"], required=True, example="Receipt"),
    Field("ledger_name", "Ledger", "LEDGERNAME", "ledger_ref",
          ["ledger", "account", "ledger name", "account name", "particulars", "party", "head"], required=True,
          value_set="ledgers", example="Customer 1"),
    Field("amount", "Amount", "AMOUNT", "amount", ["amount", "value", "total", "line amount", "entry amount"],
          example="5000.00"),
    Field("dr_cr", "Dr/Cr", None, "enum", ["dr/cr", "dr cr", "debit/credit", "type", "drcr", "side"], example="Dr",
          enum_values=["Dr", "Cr"]),
    Field("debit", "Debit Amount", None, "amount", ["debit", "debit amount", "dr amount", "dr"], example="5000.00"),
    Field("credit", "Credit Amount", None, "amount", ["credit", "credit amount", "cr amount", "cr"], example="5000.00"),
    Field("narration", "Narration", "NARRATION", "string",
          ["narration", "description", "remarks", "notes", "memo", "details"], example="Being amount received"),
    Field("party_ledger", "Party Ledger", "PARTYLEDGERNAME", "ledger_ref",
          ["party", "party name", "party ledger", "customer", "vendor", "supplier"], value_set="ledgers",
          example="Customer 1"),
    Field("stock_item", "Stock Item", "STOCKITEMNAME", "stockitem_ref",
          ["item", "stock item", "product", "item name", "sku", "goods", "material"], value_set="stock_items",
          example="Widget-1"),
    Field("quantity", "Quantity", "ACTUALQTY", "decimal", ["qty", "quantity", "units", "nos", "count"], example="100"),
    Field("rate", "Rate", "RATE", "decimal", ["rate", "price", "unit price", "unit rate", "rate per unit"],
          example="50.00"),
    Field("unit", "Unit", None, "string", ["unit", "uom", "units", "unit of measure", "uqc"], example="Nos"),
    Field("order_id", "Order ID", None, "string", ["order id", "order no", "order_name", "name"], example="#1001"),
    Field("shipping_state", "Shipping State", None, "string", ["shipping province", "shipping state", "state"],
          example="Karnataka"),
    Field("home_state", "Home State", None, "string", ["home state", "origin state", "company state", "seller state"],
          example="Maharashtra"),
    Field("gst_rate", "GST Rate (%)", None, "decimal",
          ["gst rate", "gst %", "tax rate", "gst", "tax %", "gst percent", "igst rate"], example="18"),
    Field("party_gstin", "Party GSTIN", None, "string",
          ["gstin", "party gstin", "gst no", "gst number", "customer gstin", "buyer gstin", "gst registration"],
          example="27ABCDE1234F1Z5"),
    Field("hsn", "HSN/SAC", None, "string", ["hsn", "hsn code", "sac", "hsn/sac", "hsn sac"], example="61052010"),
    Field("transaction_type", "Transaction Type", None, "string",
          ["transaction type", "financial status", "order type", "status", "kind", "sale type"], example="sale"),
    Field("commission", "Commission", None, "amount",
          ["commission", "marketplace commission", "seller fee", "referral fee"], example="120.00"),
    Field("marketplace_fee", "Fees", None, "amount",
          ["fees", "fee", "marketplace fee", "fulfillment fee", "shipping fee", "logistics fee", "closing fee"],
          example="40.00"),
    Field("tcs", "TCS", None, "amount", ["tcs", "tcs amount", "tax collected at source"], example="10.00"),
]
CATALOG = {"unit": UNIT, "group": GROUP, "stock_item": STOCK_ITEM, "ledger": LEDGER, "voucher": VOUCHER}

_SCHEMA = (
    "position int, entity string, key string, label string, tag string, dtype string, synonyms array<string>, "
    "required boolean, unique boolean, value_set string, example string, enum_values array<string>, regex string"
)


def fields(entity: str) -> list[Field]:
    return CATALOG[entity]


def catalog(spark: SparkSession, entity: str | None = None) -> DataFrame:
    """The catalog as a table: a few dozen rows, safe to broadcast."""
    chosen = CATALOG if entity is None else {entity: CATALOG[entity]}
    rows = [{"position": i, "entity": e, **asdict(f)} for e, fs in chosen.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, _SCHEMA)
