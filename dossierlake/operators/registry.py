"""The field registry as rows: what is extracted, in canonical output order, and the phrases that point to it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: (field_id, canonical name or null, type, strategy, collection, agent key)
FIELDS = (
    ("bid_number", "Bid Number", "string", "labeled_identifier", False, "solicitation_number"),
    ("title", "Title", "string", "labeled_text", False, None),
    ("due_date", "Due Date", "string", "date_time", False, "submission_deadline"),
    ("bid_submission_type", "Bid Submission Type", "string", "submission_method", False, "submission_method"),
    ("term_of_bid", "Term of Bid", "string", "contract_term", False, None),
    ("pre_bid_meeting", "Pre Bid Meeting", "string", "event_date_time", False, None),
    ("installation", "Installation", "boolean", "boolean_requirement", False, None),
    ("bid_bond_requirement", "Bid Bond Requirement", "string", "bond_requirement", False, "bid_bond"),
    ("delivery_date", "Delivery Date", "string", "delivery_timing", False, None),
    ("payment_terms", "Payment Terms", "string", "payment_terms", False, None),
    ("additional_documentation", "Any Additional Documentation Required", "collection", "required_documents", True, "affidavits"),
    ("manufacturer_registration", "MFG for Registration", "string", "manufacturer_registration", False, None),
    ("contract_or_cooperative", "Contract or Cooperative to Use", "string", "contract_vehicle", False, None),
    ("model_number", "Model_no", "collection", "model_identifier", True, "model_number"),
    ("part_number", "Part_no", "collection", "part_identifier", True, None),
    ("product", "Product", "collection", "product_table_or_labeled_text", True, None),
    ("contact_info", "contact_info", "collection", "labeled_contact", True, None),
    ("company_name", "company_name", "collection", "labeled_organization", True, None),
    ("bid_summary", "Bid Summary", "string", "evidence_summary", False, None),
    ("product_specification", "Product Specification", "collection", "technical_specification", True, None),
    ("warranty", None, "string", "agent_term_line", False, "warranty"),
    ("insurance", None, "string", "agent_term_line", False, "insurance"),
    ("mandatory_requirements", None, "string", "agent_requirement_clause", False, "mandatory_requirements"),
    ("evaluation_criteria", None, "string", "agent_term_line", False, "evaluation_criteria"),
)

# fixed values: phrases by field, separated by bars
ALIASES = {
    "bid_number": "solicitation|bid number|rfp number|solicitation number|porfp number",
    "title": "title|solicitation title|bid title",
    "due_date": "submission deadline|bid deadline|bid due|due date|closing date|responses due|solicitation due|deadline|proposal due date and time|solicitation due date",
    "bid_submission_type": "submission method|submit proposals|submit bids|procurement portal|electronic system|e-procurement|sealed bid|sealed envelope|submit by email",
    "term_of_bid": "term of bid|contract term|initial term|contract duration|renewal|option year|length of contract",
    "pre_bid_meeting": "pre-bid|pre bid|prebid meeting|conference|pre-proposal meeting|pre-bid meeting|pre-bid conference",
    "installation": "installation|deployment|deployments|imaging",
    "bid_bond_requirement": "bid bond|bid security|bond required",
    "delivery_date": "delivery|deliver by|delivery window|delivery date|delivery within",
    "payment_terms": "payment|invoice|invoices|invoice terms|net 30|invoicing|payment terms|invoicing terms|terms of payment",
    "additional_documentation": "affidavit|form|certificate|certifications|insurance|w-9|documentation|literature|credit application|addendum|required documents|"
    "additional documents|affidavits required|documentation required|must include|must provide",
    "manufacturer_registration": "manufacturer|mfg|authorized|registered|manufacturer name|manufacturer registration|mfg for registration",
    "contract_or_cooperative": "cooperative|contract vehicle|master contract|cooperative contract|state contract",
    "model_number": "model|model number|model #|model no.|si#",
    "part_number": "part|part number|sku",
    "product": "product name|product description|item description|product|item",
    "contact_info": "contact|contact information|contact person|contact name|email|email address|phone|phone number|procurement contact|buyer",
    "company_name": "issuing organization|issuing agency|agency name|company name|organization name|purchasing entity|issued by",
    "bid_summary": "summary|overview|scope",
    "product_specification": "specification|cpu|ram|storage|display|processor|windows|ddr|ssd|wi-fi|wireless|battery|adapter|energy star",
    "warranty": "warranty|warranties|extended warranty",
    "insurance": "insurance|certificate of insurance",
    "mandatory_requirements": "must|mandatory|required",
    "evaluation_criteria": "evaluation|scoring|criteria",
}
VALIDATION_LABELS = {
    "bid_number": "bid number|rfp number|solicitation number|porfp number",
    "title": "title:|request for proposal",
    "due_date": "submission deadline|due date|proposal due date|solicitation due|bid deadline",
    "bid_submission_type": "submission method|bid submission instructions|e-procurement",
    "term_of_bid": "initial term|term of bid|length of contract",
    "pre_bid_meeting": "pre-proposal meeting|pre-bid meeting|pre-bid conference",
    "installation": "installation:|installation is",
    "bid_bond_requirement": "bid bond|bid security",
    "delivery_date": "delivery date|delivery window|delivery within|deliver by",
    "payment_terms": "payment terms|invoicing terms|invoice(s)",
    "additional_documentation": "required documents|additional documents|must include|must provide",
    "manufacturer_registration": "manufacturer name|manufacturer registration|mfg for registration",
    "contract_or_cooperative": "cooperative|master contract|contract vehicle",
    "model_number": "model number|model #|si#",
    "part_number": "part number|sku",
    "product": "product:|product name:",
    "contact_info": "buyer|contact:",
    "company_name": "organization|company name",
    "product_specification": "specification|processor|memory|display",
}
AGENT_GROUPS = {
    "submission": ("solicitation_number", "submission_deadline", "submission_method"),
    "commercial": ("bid_bond", "warranty", "insurance"),
    "compliance": ("affidavits", "mandatory_requirements", "evaluation_criteria"),
    "product": ("model_number",),
}


def fields(spark: SparkSession) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(FIELDS, 1)]
    return spark.createDataFrame(rows, "ordinal int, field_id string, canonical_name string, value_type string, strategy string, is_collection boolean, agent_key string")


def terms(spark: SparkSession) -> DataFrame:
    """(field_id, list_kind, term)"""
    rows = [(f, kind, t) for kind, lists in (("alias", ALIASES), ("validation_label", VALIDATION_LABELS)) for f, joined in lists.items() for t in joined.split("|")]
    return spark.createDataFrame(rows, "field_id string, list_kind string, term string")


def labels(canonical: str) -> tuple[str, ...]:
    field_id = next((f for f, name, *_ in FIELDS if name == canonical), "")
    return tuple(x for x in VALIDATION_LABELS.get(field_id, "").split("|") if x)
