"""Vocabularies, tables, patterns and weights that results depend on."""

from __future__ import annotations

# Fixed values. Closed vocabularies.
SPECIES = ("ALPHA_DRACONIAN", "ANDROMEDAN", "AQUARIAN_MANTIS", "ARCTURIAN", "CENTAURI_SYNTH", "JOVIAN_GASFORM", "KAIJU_MICRO", "LUNA_SECURID", "ORION_GRAYS", "SIRIUS_AVIAN", "TRIANGULAN", "VENUSIAN_MYCELIAL")
WORLDS = ("Barnard-c", "Eris Relay", "Europa Station", "Gliese-581g", "Kepler-186f", "Luyten-b", "Mars Dome-7", "Proxima-b", "Sirius Outpost", "Titan Freeport", "TRAPPIST-1e", "Wolf-1061c", "Zeta Reticuli")
VISAS = ("XW-1", "XW-2", "DIP-1", "MED-3", "TRANSIT-7")
PURPOSES = ("archive audit", "cultural exchange", "diplomatic", "field repair", "medical consult", "reactor maintenance", "research", "transit", "translation", "xenobotany")
DISQUALIFYING = ("memory_tampering", "planetary_embargo", "active_warrant", "biohazard_red")
REVIEW = ("identity_conflict", "sponsor_mismatch", "illegible_biometrics", "rescinded_denial")
FLAGS = DISQUALIFYING + REVIEW
FEES = ("paid", "waived", "unpaid", "unknown")
APPROVED, DENIED, NEEDS_REVIEW = OUTCOMES = ("APPROVED", "DENIED", "NEEDS_REVIEW")
REVOKED_PUBLIC = ("SPN-0007", "SPN-0139", "SPN-4040")
REVOKED_MINED = ("SPN-2718", "SPN-7331", "SPN-9090")
REVOKED = REVOKED_PUBLIC + REVOKED_MINED
EMBARGOED = ("Wolf-1061c",)
STALE_DAYS = 180
UNKNOWN = "unknown"
#: Points of a prediction (first) given the truth, in the order of OUTCOMES.
PAYOFF = {"APPROVED": (8.0, -4.0, 1.0), "DENIED": (0.0, 8.0, 1.0), "NEEDS_REVIEW": (2.0, 2.0, 8.0)}
APPROVAL_MARGIN = 1.5

# Fixed values. Field labels, most specific first, and lines that are never values.
LABELS = {
    "applicant_name": ("APPLICANT NAME", "REGISTRY NAME", "APPLICANT"),
    "species_code": ("SPECIES CODE", "SPECIES MATCH", "SPECIES"),
    "home_world": ("HOME WORLD", "HOMEWORLD"),
    "visa_class": ("VISA CLASS", "VISA"),
    "sponsor_id": ("SPONSOR ID", "SPONSOR"),
    "arrival_date": ("ARRIVAL DATE", "ARRIVAL"),
    "declared_purpose": ("DECLARED PURPOSE", "PURPOSE"),
    "fee_status": ("FEE STATUS",),
    "risk_flags": ("OBSERVED FLAGS", "RISK FLAGS", "FLAGS"),
}
OTHER_LABELS = ("CASE ID", "AMOUNT", "WAIVER CODE", "REGISTRY STATUS", "FINDING", "BIOMETRIC CONFIDENCE", "PRIMARY INTAKE RECORD")
CLOSED_FIELDS = ("species_code", "home_world", "visa_class", "declared_purpose", "fee_status", "risk_flags")
FUSED_LABELS = {
    "fee_status": ("FeeStatus", "Status"),
    "visa_class": ("VisaClass", "Class"),
    "species_code": ("SpeciesCode", "Species"),
    "home_world": ("HomeWorld", "World"),
    "declared_purpose": ("DeclaredPurpose", "Purpose"),
    "risk_flags": ("ObservedFlags", "Flags"),
}
FUSED_VOCABULARY = {"fee_status": FEES, "visa_class": VISAS, "species_code": SPECIES, "home_world": WORLDS, "declared_purpose": PURPOSES, "risk_flags": ("none", *FLAGS)}
CELL_LABELS = {
    "fee_status": ("fee", "status"),
    "sponsor_id": ("sponsor", "id"),
    "visa_class": ("visa", "class"),
    "arrival_date": ("arrival", "date"),
    "species_code": ("species", "code"),
    "risk_flags": ("observed", "flags"),
    "declared_purpose": ("declared", "purpose"),
    "home_world": ("home", "world"),
}

# Fixed values. Authority of page kinds.
PAGE_RANK = {"manual": 6, "intake": 5, "biometric": 4, "fee": 4, "sponsor": 3, "registry": 2, "unknown": 0}
IDENTITY_RANK = {"manual": 6, "biometric": 5, "registry": 4, "sponsor": 3, "intake": 2, "fee": 2, "unknown": 0}

# Fixed values. Damage tags: words that mark damage, and the field each token names.
DAMAGE_WORDS = ("CUT OUT", "BLANK", "WHITEOUT", "LOST", "WASHED", "OBSCURED", "TORN", "ILLEGIBLE", "MISSING", "REDACTED", "UNREADABLE")
DAMAGE_FIELDS = (("SPONSOR", "sponsor_id"), ("SPECIES", "species_code"), ("VISA", "visa_class"), ("FEE", "fee_status"), ("PURPOSE", "declared_purpose"), ("WORLD", "home_world"), ("DATE", "arrival_date"), ("NAME", "applicant_name"))

# Fixed values. Patterns; (?i) where case does not matter.
INJECTION = r"(?i)(ANSWER\s*KEY|BARCODE\s+PAYLOAD|OUTPUT\s+THIS|\bSYSTEM\s*:|FORCE\s+ADJUDICATION|IGNORE\s+(ALL|PREVIOUS)|DO\s+NOT\s+OCR)"
#: In capitals, one of these is in whatever INJECTION matches.
INJECTION_WORDS = ("ANSWER", "PAYLOAD", "OUTPUT", "SYSTEM", "FORCE", "IGNORE", "OCR")
FOOTER = r"(?i)Packet\s+MIB-\d+.*|Synthetic hiring.*"
NOISE = r"(?i)^(Packet\s+MIB-\d+|Synthetic hiring|MIB-\d+\s*\|\s*MIB Eyes Only|(REGISTRY|PASSPORT|SCAN|BIOMETRIC)\s+IMAGE|N/?A|-+)\s*$"
FINDING = r"(?i)FINDING\s*[:\-]?\s*(APPROVED|DENIED|NEEDS[\s_]*REVIEW)|(APPROVED|DENIED|NEEDS[\s_]*REVIEW)\s*[:\-]?\s*FINDING"
RECEIPT = r"(?i)(?:RECEIVED|RECEIPT\s+DATE|PACKET\s+RECEIVED)\s*[:\-]?\s*([0-9]{4}-[0-9]{2}-[0-9]{2})"
REGISTRY = r"(?i)REGISTRY\s+STATUS\s*[:\n]?\s*([A-Z][A-Z ]{2,25})"
DAMAGE_TAG = r"\[([A-Z][A-Z ]{2,28})\]"
WAIVER_CODE = r"(?i)WAIVER\s+CODE\s*[:\-]?\s*(?!N/?A\b)([A-Z][A-Z0-9-]{2,})"
STANDARD_FEE = r"\$\s*809([.,]0{2})?\b"
HARDSHIP = r"(?i)HARDSHIP\s+WAIVER|WAIVER\s+APPROVED|DIP-?WAIVER"
DIPLOMATIC = r"(?i)DIPLOMATIC\s+NOTE"
SPONSOR_CORRECTION = r"(?i)(?:MANUAL\s+)?CORRECTION[^.\n]*?SPONSOR\s+(?:IS|=|:)?\s*([A-Z0-9-]{6,10})"
SPONSOR_PROSE = r"(?i)\bSPONSOR\s+(S[PFR][NRM][-\s]?[0-9OQDILZSBGT]{4})\b"
CORRECTIONS = {
    "visa_class": r"(?i)CORRECTION[^.\n]*?VISA\s+CLASS\s+(?:IS|=|:)?\s*([A-Z0-9-]{3,12})",
    "fee_status": r"(?i)CORRECTION[^.\n]*?FEE\s+STATUS\s+(?:IS|=|:)?\s*([A-Za-z]{3,10})",
    "applicant_name": r"(?i)CORRECTION[^.\n]*?APPLICANT\s+(?:IS|=|:)?\s*([^.\n]{3,40})",
}
COMPLIANCE = r"(?i)RESPONSIBILITY\s+FOR\s+CLASS\s+([A-Z0-9-]{3,12})\s+COMPLIANCE"
FLAG_LABEL = r"(?i)\b[o0][bh]?s[ea]rv[ea]d\s+f[il1]ags?\b|\brisk\s+f[il1]ags?\b"
FLAG_NONE = r"(?i)^\W*(?:none|nene|nune|no[nm]e|n/?a)\W*$"
#: What Python calls line ends, for splitting text into lines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
OTHER_LINE_END = "[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"

# Fixed values. Page anchors and classes, in order.
ANCHORS = ("FEE STATUS", "APPLICANT", "SPECIES", "SPONSOR", "ARRIVAL", "VISA", "HOME WORLD", "OBSERVED", "REGISTRY", "BIOMETRIC", "FINDING", "AMOUNT")
PAGE_CLASSES = (
    ("manual", (("MANUAL ADJUDICATOR",), ("FINDING",))),
    ("intake", (("WORK AUTHORIZATION",), ("PRIMARY INTAKE",), ("FORM I 8090",), ("FORM J 8090",))),
    ("biometric", (("BIOMETRIC",), ("BIOHAZARD",))),
    ("fee", (("FEE RECEIPT",), ("FEE STATUS", "AMOUNT"))),
    ("sponsor", (("SPONSOR ATTESTATION",), ("SPONSOR", "ATTESTS"))),
    ("registry", (("REGISTRY EXTRACT",), ("REGISTRY STATUS",))),
)

# Fixed values. Glyphs that are mistaken for one another, glyph pairs that fuse, and their costs.
CONFUSABLE = (
    ("0", "O"), ("0", "Q"), ("0", "D"), ("1", "I"), ("1", "L"), ("1", "T"), ("2", "Z"), ("5", "S"), ("6", "G"), ("8", "B"), ("7", "T"), ("4", "A"),
    ("C", "G"), ("E", "F"), ("I", "L"), ("K", "X"), ("M", "N"), ("O", "Q"), ("P", "R"), ("U", "V"), ("V", "Y"), ("W", "V"), ("H", "N"), ("R", "B"), ("S", "V"),
)
LIGATURES = (("RR", "M"), ("NI", "M"), ("RI", "N"), ("VV", "W"), ("CL", "D"), ("LI", "U"), ("IN", "M"), ("NN", "M"))
CONFUSABLE_COST, LIGATURE_COST, SWAP_COST = 0.35, 0.45, 0.7
DIGIT_FROM, DIGIT_TO = "OQDILZSBGT", "0001125867"

# Fixed values. Names: the tokens seen, and the stems and suffixes that generate more.
NAMES = (
    "Aridane Ariix Arikesh Arimora Arinax Ariquell Aririx Aritari Ariul Arivara Arivoss Arizarn "
    "Ixodane Ixoix Ixokesh Ixomora Ixonax Ixoquell Ixorix Ixotari Ixoul Ixovara Ixovoss Ixozarn "
    "Ludane Luix Lukesh Lumora Lunax Luquell Lurix Lutari Luul Luvara Luvoss Luzarn "
    "Miradane Miraix Mirakesh Miramora Miranax Miraquell Mirarix Miratari Miraul Miravara Miravoss Mirazarn "
    "Nexdane Nexix Nexkesh Nexmora Nexnax Nexquell Nexrix Nextari Nexul Nexvara Nexvoss Nexzarn "
    "Oridane Oriix Orikesh Orimora Orinax Oriquell Oririx Oritari Oriul Orivara Orivoss Orizarn "
    "Qordane Qorix Qorkesh Qormora Qornax Qorquell Qorrix Qortari Qorul Qorvara Qorvoss Qorzarn "
    "Soldane Solix Solkesh Solmora Solnax Solquell Solrix Soltari Solul Solvara Solvoss Solzarn "
    "Tekdane Tekix Tekkesh Tekmora Teknax Tekquell Tekrix Tektari Tekul Tekvara Tekvoss Tekzarn "
    "Veedane Veeix Veekesh Veemora Veenax Veequell Veerix Veetari Veeul Veevara Veevoss Veezarn "
    "Xandane Xanix Xankesh Xanmora Xannax Xanquell Xanrix Xantari Xanul Xanvara Xanvoss Xanzarn "
    "Zadane Zaix Zakesh Zamora Zanax Zaquell Zarix Zatari Zaul Zavara Zavoss Zazarn"
).split()
NAME_STEMS = "ari ixo luv mir nex ori qor sol tek vee xan zav".split()
NAME_SUFFIXES = "ane ara ari arn ax dane esh ix kesh l mora nax ora oss quell rix tari uell ul vara voss x zarn".split()

# Fixed values. Paths that never approve, and outcome odds by path, in the order of OUTCOMES.
NO_APPROVAL = ("risk_page_absent", "risk_page_unreadable", "risk_page_unreadable_med", "arrival_date_unknown", "arrival_date_untrusted", "visa_unknown", "sponsor_unknown", "fee_unknown", "fee_stated_unknown", "staleness_indeterminate", "adjudicator_conflict", "stamp_contested", "unreadable_packet")
FALLBACK = (0.2, 0.2, 0.6)
CALIBRATION = {
    "adjudicator_conflict": (0.16666666666666666, 0.08333333333333333, 0.75),
    "arrival_date_unknown": (0.38181818181818183, 0.36363636363636365, 0.2545454545454545),
    "clean": (0.9, 0.025, 0.075),
    "disqualifying_flag": (0.014705882352941176, 0.9705882352941176, 0.014705882352941176),
    "embargoed_home_world": (0.07692307692307693, 0.8461538461538461, 0.07692307692307693),
    "fee_stated_unknown": (0.034482758620689655, 0.06896551724137931, 0.896551724137931),
    "fee_unknown": (0.6923076923076923, 0.10256410256410256, 0.20512820512820512),
    "fee_unpaid": (0.029411764705882353, 0.9117647058823529, 0.058823529411764705),
    "fee_waived_unjustified": (0.42592592592592593, 0.25925925925925924, 0.3148148148148148),
    "manual_approved": (0.96875, 0.015625, 0.015625),
    "manual_denied": (0.007194244604316547, 0.9856115107913669, 0.007194244604316547),
    "manual_needs_review": (0.010869565217391304, 0.010869565217391304, 0.9782608695652174),
    "registry_embargo": (0.07142857142857142, 0.7857142857142857, 0.14285714285714285),
    "review_flags": (0.021739130434782608, 0.13043478260869565, 0.8478260869565217),
    "risk_page_absent": (0.6333333333333333, 0.13333333333333333, 0.23333333333333334),
    "risk_page_unreadable": (0.3783783783783784, 0.1891891891891892, 0.43243243243243246),
    "risk_page_unreadable_med": (0.4, 0.3, 0.3),
    "sponsor_revoked": (0.038461538461538464, 0.9423076923076923, 0.019230769230769232),
    "sponsor_unknown": (0.6363636363636364, 0.18181818181818182, 0.18181818181818182),
    "stale_arrival": (0.41379310344827586, 0.5172413793103449, 0.06896551724137931),
    "stamp_denied": (0.21739130434782608, 0.43478260869565216, 0.34782608695652173),
    "transit_7": (0.02857142857142857, 0.8571428571428571, 0.11428571428571428),
    "visa_unknown": (0.4074074074074074, 0.3333333333333333, 0.25925925925925924),
}
PRIORS = {"declared_purpose": "reactor maintenance", "fee_status": "paid", "home_world": "Luyten-b", "risk_flags": "none", "species_code": "TRIANGULAN", "visa_class": "MED-3"}

# Fixed values. The resolver: features in order, their means, deviations and weights for OUTCOMES, and the bias.
FEATURES = ("fee_paid", "fee_waived", "fee_known", "registry_clear", "registry_read", "visa_known", "visa_dip1", "visa_med3", "visa_transit", "sponsor_known", "name_known", "species_known", "world_known", "date_known", "purpose_known", "flags_read", "has_scan", "injection", "missing_count", "page_count", "ocr_confidence", "waiver_seen")
BIAS = (0.4928386962711076, -0.5886870673537127, 0.09584837108260445)
MU = (0.42424242424242425, 0.12396694214876033, 0.5509641873278237, 0.5041322314049587, 0.5041322314049587, 0.8732782369146006, 0.24793388429752067, 0.2231404958677686, 0.0, 0.8732782369146006, 0.9228650137741047, 0.9090909090909091, 0.8512396694214877, 0.8292011019283747, 0.8429752066115702, 0.23415977961432508, 0.6914600550964187, 0.17355371900826447, 1.3471074380165289, 3.5399449035812673, 0.875226933785269, 0.11294765840220386)
SIGMA = (0.49422746758485103, 0.3295438353285442, 0.49739587011756975, 0.49998292437203756, 0.49998292437203756, 0.3326610254387, 0.43181323892936097, 0.41635179232429775, 1.0, 0.33266102543869985, 0.26680550992403906, 0.2874797872880356, 0.3558520684563808, 0.3763331429586607, 0.36382414385215006, 0.42347252239702116, 0.4618907309120585, 0.37872526404593754, 1.6616435015363913, 0.806602914343354, 0.08076343093541323, 0.31652880574074643)
WEIGHTS = (
    (0.21464165210613356, 0.24171333362213235, -0.4563549857282666),
    (0.43310787298226794, -0.25361809325531826, -0.17948977972694932),
    (0.053423022539703414, -0.0694133974690625, 0.01599037492935896),
    (0.09194818029852708, 0.06379457015936663, -0.15574275045789376),
    (0.09194818029852708, 0.06379457015936663, -0.15574275045789376),
    (0.010877766795901914, -0.09092878888934235, 0.08005102209344027),
    (0.11659564316055383, -0.18137738482878765, 0.06478174166823399),
    (0.026544502548138418, 0.2790632084636958, -0.30560771101183437),
    (0.0, 0.0, 0.0),
    (-0.056978438695079285, -0.14403870324642545, 0.20101714194150486),
    (-0.11822031560127895, -0.07664251459276031, 0.19486283019403924),
    (-0.0715051336653236, 0.15485510710336972, -0.0833499734380463),
    (-0.02833859482051865, -0.12746119093161182, 0.15579978575213047),
    (0.08514709911011684, -0.14587732742245071, 0.0607302283123342),
    (0.12263979406798534, 0.1308518430669562, -0.25349163713494133),
    (0.39719325408641104, -0.14653032838739447, -0.2506629256990167),
    (0.09256257216544467, 0.45458852061181226, -0.5471510927772573),
    (-0.17650488200618575, 0.33262409615291405, -0.1561192141467282),
    (-0.015476862324961975, 0.08501833150551, -0.06954145700654364),
    (-0.2132396959544384, -0.2008906169213857, 0.414130312875824),
    (-0.010642724489289223, 0.22804860500674287, -0.21740588051745344),
    (-0.30994833762047763, 0.4897946456163461, -0.17984630799586873),
)

# Fixed values. Scoring.
FIELD_WEIGHTS = {"applicant_name": 5, "species_code": 6, "home_world": 5, "visa_class": 5, "sponsor_id": 5, "arrival_date": 4, "declared_purpose": 3, "risk_flags": 8, "fee_status": 4}
OUTPUT_FIELDS = ("case_id", "applicant_name", "species_code", "home_world", "visa_class", "sponsor_id", "arrival_date", "declared_purpose", "risk_flags", "fee_status", "adjudication", "confidence")
BLANKS = {"sponsor_id": "SPN-0000", "arrival_date": "1900-01-01"}
