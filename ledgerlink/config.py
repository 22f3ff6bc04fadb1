"""Thresholds and fixed values of the matching rules.

Values here are fixed: results depend on them being exactly these.
"""

from __future__ import annotations

# Label normalisation
ABBREVIATIONS = {
    "REGLT": "REGLEMENT", "RGLT": "REGLEMENT", "RGT": "REGLEMENT", "REGL": "REGLEMENT", "MT": "MONTANT", "MNT": "MONTANT",
    "VIR": "VIREMENT", "VIRT": "VIREMENT", "PAIE": "PAIEMENT", "PMT": "PAIEMENT", "PAYMT": "PAIEMENT", "FACT": "FACTURE",
    "FAC": "FACTURE", "FC": "FACTURE", "AVO": "AVOIR", "CMD": "COMMANDE", "BDC": "BON DE COMMANDE", "LIV": "LIVRAISON",
    "BL": "BON DE LIVRAISON", "ECH": "ECHEANCE", "TRIM": "TRIMESTRE", "SEM": "SEMESTRE", "REF": "REFERENCE",
}
BANK_PREFIXES = (
    "VIRT RECU DE", "VIREMENT RECU DE", "PAYMENT FROM", "PAIEMENT DE", "VIR DE", "VIR RECU", "CREDIT TRANSFER FROM",
    "SEPA CREDIT TRANSFER", "SCT", "REMISE", "ENCAISSEMENT",
)
NUMERIC_PADDING = 6

# Extraction (Java regular expressions, group 1 is the reference)
REF_PATTERNS = (
    r"(?i)\b(FAC(?:T(?:URE)?)?[\s\-/]*\d{4}[\s\-/]*\d{3,10})\b",
    r"(?i)\b(INV(?:OICE)?[\s\-/]*\d{3,10})\b",
    r"(?i)\b(FC[\s\-/]*\d{3,10})\b",
    r"\b([A-Z]{2,4}[\-/]\d{4}[\-/]\d{3,8})\b",
    r"(?<![A-Za-z])(?<!\d)(\d{6,10})(?!\d)",
    r"(?i)\b(BL[\s\-/]*\d{3,10})\b",
    r"(?i)\b((?:PO|CMD|BC)[\s\-/]*\d{3,10})\b",
    r"(?i)\b(CMR[\s\-/]*\d{3,10})\b",
    r"(?i)\b(DAE[\s\-/]*\d{4}[\s\-/]*\d{3,6})\b",
)
AMOUNT_PATTERN = r"(\d{1,3}(?:[.\s]\d{3})*[,]\d{2}|\d{1,3}(?:[,\s]\d{3})*[.]\d{2}|\d+[.,]\d{2})"
PERIOD_PATTERNS = (
    r"(?i)\b(JANV(?:IER)?|FEV(?:RIER)?|MARS|AVR(?:IL)?|MAI|JUIN|JUIL(?:LET)?|AOUT|SEPT(?:EMBRE)?|OCT(?:OBRE)?|NOV(?:EMBRE)?|DEC(?:EMBRE)?)\s*(\d{2,4})?\b",
    r"(?i)\b(JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEPT?(?:EMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)\s*(\d{2,4})?\b",
    r"(?i)\b[QT]([1-4])\s*(\d{2,4})?\b",
    r"(?i)\bS([12])\s*(\d{2,4})?\b",
)
MONTHS = {
    "JANV": 1, "JANVIER": 1, "JAN": 1, "JANUARY": 1, "FEV": 2, "FEVRIER": 2, "FEB": 2, "FEBRUARY": 2, "MARS": 3, "MAR": 3,
    "MARCH": 3, "AVR": 4, "AVRIL": 4, "APR": 4, "APRIL": 4, "MAI": 5, "MAY": 5, "JUIN": 6, "JUN": 6, "JUNE": 6, "JUIL": 7,
    "JUILLET": 7, "JUL": 7, "JULY": 7, "AOUT": 8, "AUG": 8, "AUGUST": 8, "SEPT": 9, "SEPTEMBRE": 9, "SEP": 9,
    "SEPTEMBER": 9, "OCT": 10, "OCTOBRE": 10, "OCTOBER": 10, "NOV": 11, "NOVEMBRE": 11, "NOVEMBER": 11, "DEC": 12,
    "DECEMBRE": 12, "DECEMBER": 12,
}
KEYWORDS = {
    "partial": ("ACOMPTE", "PARTIEL", "PARTIAL", "ADVANCE", "A VALOIR", "A COMPTE"),
    "credit_note": ("AVOIR", "CREDIT", "NOTE DE CREDIT", "CREDIT NOTE", "CN", "AVVOIR"),
    "advance": ("ACOMPTE", "ADVANCE", "AVANCE", "PREPAYMENT"),
    "final": ("SOLDE", "FINAL", "DERNIER", "CLOTURE", "BALANCE"),
    "penalty": ("PENALITE", "PENALTY", "INTERET", "INTEREST", "RETARD"),
    "discount": ("ESCOMPTE", "DISCOUNT", "REMISE"),
    "retention": ("RETENUE", "RETENTION", "GARANTIE"),
}
CURRENCIES = {"€": "EUR", "EUR": "EUR", "EURO": "EUR", "EUROS": "EUR", "$": "USD", "USD": "USD", "US$": "USD", "USD$": "USD", "£": "GBP", "GBP": "GBP", "CHF": "CHF"}
LANGUAGE_WORDS = {
    "EN": ("PAYMENT", "INVOICE", "AMOUNT", "TRANSFER", "RECEIPT", "BALANCE"),
    "FR": ("REGLEMENT", "FACTURE", "MONTANT", "VIREMENT", "PAIEMENT", "AVOIR"),
    "DE": ("ZAHLUNG", "RECHNUNG", "BETRAG", "UBERWEISUNG"),
    "NL": ("BETALING", "FACTUUR", "BEDRAG", "OVERSCHRIJVING"),
    "ES": ("PAGO", "FACTURA", "IMPORTE", "TRANSFERENCIA"),
    "IT": ("PAGAMENTO", "FATTURA", "IMPORTO", "BONIFICO"),
}
ENTITY_PATTERNS = {
    "INVOICE_REF": r"(?i)\b(FAC(?:T(?:URE)?)?[\s\-/]*\d{4,10})\b",
    "PO_REF": r"(?i)\b((?:PO|CMD|BC|COMMANDE)[\s\-/]*\d{3,10})\b",
    "BL_REF": r"(?i)\b(BL[\s\-/]*\d{3,10})\b",
    "AMOUNT": r"\b(\d{1,3}(?:[.\s]\d{3})*[,]\d{2})\s*(?:EUR|€)?\b",
    "DATE": r"\b(\d{2}[/\-]\d{2}[/\-]\d{2,4})\b",
    "PERIOD": r"(?i)\b((?:JANV|FEV|MARS|AVR|MAI|JUIN|JUIL|AOUT|SEPT|OCT|NOV|DEC)\w*\s*\d{2,4})\b",
    "DEBTOR_CODE": r"(?i)\b(CLT[\s\-/]*\d{4,8})\b",
    "IBAN": r"\b([A-Z]{2}\d{2}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4})\b",
    "CREDIT_NOTE": r"(?i)\b(AV(?:OIR)?[\s\-/]*\d{3,10})\b",
    "CONTRACT": r"(?i)\b(CTR[\s\-/]*\d{3,10})\b",
}

# references
REF_PREFIXES = ("FAC", "F", "FACT", "INV", "FC", "INVOICE", "BILL", "BL", "CMD", "BON")
ISO_CONFIDENCE = {"roc_ref": 1.00, "rfb_ref": 1.00, "inv_number": 0.99, "end_to_end_id": 0.97, "tx_id": 0.95, "bv_ref": 0.93}

# tolerances
SEPA_COUNTRIES = (
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV",
    "MC", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK", "SM", "CH", "GB",
)
WITHHOLDING_PERCENT = {"MA": 20, "DZ": 24, "TN": 15, "TR": 18, "IN": 10, "BR": 15, "AR": 21, "EG": 20}
SWIFT_FEE_CENTS, OUR_FEE_CENTS, ROUNDING_CENTS = 3500, 1500, 100
BTP_RETENTION_PERCENT = (3, 5, 10)
INSTALLMENT_PERCENT = (30, 40, 50, 70)
SUBSET_MAX_INVOICES = 15
UNIQUE_AMOUNT_DAYS = 120
PERIOD_WINDOWS = (1, 2, 3, 6)

# layers
AUTO_CONFIDENCE, FUZZY_CONFIDENCE, ML_CONFIDENCE = 0.90, 0.80, 0.85
FUZZY_MIN, FUZZY_CAP, NLP_CAP, TFIDF_CAP = 0.60, 0.95, 0.92, 0.88
FUZZY_WEIGHTS = {"levenshtein": 0.15, "jaro_winkler": 0.15, "token_sort": 0.10, "token_set": 0.10, "partial": 0.15, "ngram": 0.10, "lcs": 0.10, "numeric": 0.15}
LAYER_NAMES = {0: "C0", 1: "C1", 2: "C2", 3: "C3", 4: "C4", 5: "C5", 6: "C6"}
