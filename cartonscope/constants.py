"""Word lists, lookup tables, thresholds, identifiers and message texts.

Everything in this file is data that results depend on. Logic lives elsewhere.
"""

# --- fixed values: anchor dictionary (group -> language -> terms) -----------------------------
ANCHOR_TERMS = {
    "mrp": {
        "eng": ["mrp", "m.r.p", "maximum retail price", "retail price", "rs.", "rs", "₹", "price"],
        "hin": ["अधिकतम खुदरा मूल्य", "मूल्य", "एम.आर.पी"],
        "guj": ["મહત્તમ છૂટક કિંમત", "કિંમત"],
    },
    "tax_inclusive": {
        "eng": ["incl. of all taxes", "inclusive of all taxes", "incl of all taxes", "including all taxes"],
        "hin": ["सभी करों सहित", "करों सहित"],
        "guj": ["તમામ કરવેરા સહિત"],
    },
    "net_qty": {
        "eng": ["net qty", "net quantity", "net wt", "net weight", "net vol", "net volume", "contents"],
        "hin": ["शुद्ध मात्रा", "शुद्ध वजन"],
        "guj": ["ચોખ્ખો જથ્થો", "ચોખ્ખું વજન"],
    },
    "mfg_date": {
        "eng": ["mfd", "mfg date", "mfg.date", "manufactured on", "packed on", "pkd on", "pkd", "mfg",
                "packing date"],
        "hin": ["निर्माण तिथि", "पैकिंग तिथि"],
        "guj": ["ઉત્પાદન તારીખ", "પેકિંગ તારીખ"],
    },
    "best_before": {
        "eng": ["best before", "use by", "expiry", "exp date", "exp.", "best before date"],
        "hin": ["सर्वोत्तम पहले", "उपयोग करें"],
        "guj": ["શ્રેષ્ઠ પહેલાં", "વાપરવાની છેલ્લી તારીખ"],
    },
    "consumer_care": {
        "eng": ["consumer care", "customer care", "for complaints", "contact", "helpline", "toll free"],
        "hin": ["उपभोक्ता देखभाल", "ग्राहक सेवा"],
        "guj": ["ગ્રાહક સંભાળ"],
    },
    "manufacturer": {
        "eng": ["manufactured by", "mfd by", "marketed by", "packed by", "manufacturer", "packer"],
        "hin": ["निर्माता", "द्वारा निर्मित", "द्वारा पैक"],
        "guj": ["ઉત્પાદક", "દ્વારા ઉત્પાદિત"],
    },
    "country_of_origin": {
        "eng": ["country of origin", "made in", "product of"],
        "hin": ["मूल देश", "में निर्मित"],
        "guj": ["મૂળ દેશ"],
    },
    "unit_sale_price": {
        "eng": ["unit sale price", "price per", "usp", "rs./kg", "rs./l"],
        "hin": ["इकाई विक्रय मूल्य"],
        "guj": ["એકમ વેચાણ કિંમત"],
    },
}
FUZZY_MIN_TERM_LENGTH = 10
STRAY_MIN_TERM_LENGTH = 5

# --- fixed values: digits, units, scripts -----------------------------------------------------
INDIC_DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯"
ASCII_DIGITS = "01234567890123456789"
QUANTITY_UNITS = ["g", "gm", "gms", "gram", "grams", "kg", "kilogram", "ml", "milliliter", "l",
                  "litre", "liter", "pcs", "pieces", "nos"]
UNIT_CATEGORY = {
    "g": "solid", "gm": "solid", "gms": "solid", "gram": "solid", "grams": "solid", "kg": "solid",
    "kilogram": "solid",
    "ml": "liquid", "milliliter": "liquid", "l": "liquid", "litre": "liquid", "liter": "liquid",
    "pcs": "count", "pieces": "count", "nos": "count",
}
COUNT_UNITS = ["pieces", "piece", "pcs", "nos", "no", "count", "units", "unit"]
MISLEADING_TERMS = ["minimum", "min.", "not less than", "average", "about", "approx.", "approximately"]
SCRIPT_NOISE_TOLERANCE = 2
MIN_REREAD_ALNUM = 3
COMBINED_READER = "eng+hin+guj"

# --- fixed values: the fifteen declarations ---------------------------------------------------
DECLARATION_FIELDS = [
    "manufacturer_name", "manufacturer_address", "country_of_origin", "common_generic_name",
    "net_quantity_value", "net_quantity_unit", "mfg_month_year", "best_before_use_by",
    "mrp_value", "mrp_inclusive_of_taxes_stated", "consumer_care_name", "consumer_care_address",
    "consumer_care_phone", "consumer_care_email", "unit_sale_price",
]
QUALITY_FIELDS = ["manufacturer_name", "net_quantity_value", "mfg_month_year", "mrp_value",
                  "consumer_care_name"]
ABSENT_ANSWERS = ["null", "none", "n/a", "not printed", "not visible"]

# --- fixed values: geometry thresholds --------------------------------------------------------
LINE_MIN_TOLERANCE_PX = 8
LINE_HEIGHT_RATIO = 0.4
WORD_MIN_GAP_PX = 40
WORD_GAP_HEIGHT_RATIO = 2.5
ROW_BAND_RATIO = 0.5
ROW_GAP_HEIGHT_RATIO = 8.0
GROUPING_PASS_RATIO = 0.35
GROUPING_FAIL_RATIO = 0.45
GROUPING_OUTLIER_MULTIPLE = 2.5
DISPROPORTION_RATIO = 0.35
LOW_CONFIDENCE = 60.0
# (area above, area up to and including, minimum numeral height in mm)
HEIGHT_TABLE_MM = [(0, 50, 1.0), (50, 100, 1.5), (100, 500, 2.5), (500, 2500, 4.0), (2500, None, 6.0)]

# --- fixed values: image planning -------------------------------------------------------------
MIN_SHORTER_SIDE_PX = 320
MIN_SHARPNESS = 100.0
MAX_LONGEST_SIDE_PX = 2200
MAX_UPSCALED_SIDE_PX = 3200
UPSCALE_TEXT_HEIGHT_PX = 25
MAX_UPSCALE = 3.0
MIN_SKEW_LINES = 8
SKEW_TOLERANCE_DEG = 1.0
MIN_SKEW_AGREEMENT = 0.6
MIN_ROTATION_DEG = 0.5

# --- fixed values: uploads and arrivals -------------------------------------------------------
UPLOAD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff"]
UPLOAD_CONTENT_TYPES = ["image/jpeg", "image/png", "image/webp", "image/bmp", "image/tiff"]
MAX_UPLOAD_BYTES = 12 * 1024 * 1024
ARRIVAL_LIMIT = 12
ARRIVAL_WINDOW_SECONDS = 60

# --- fixed values: statuses, versions, roll-ups -----------------------------------------------
PASS, FAIL = "PASS", "FAIL"
NEEDS_VERIFICATION, NOT_APPLICABLE = "NEEDS_VERIFICATION", "NOT_APPLICABLE"
SEVERITY = {FAIL: 0, NEEDS_VERIFICATION: 1, PASS: 2, NOT_APPLICABLE: 3}
RULESET_VERSION = "2026-08-26-draft1"
SCORE_HIGH, SCORE_MID = 80.0, 50.0
TREND_DAYS = 30
RECENT_FAILURES = 10
UNKNOWN_PRODUCT = "Unknown"

# --- fixed values: rule catalogue (id, reference, requirement) --------------------------------
RULES = {
    "R6-1": ("Rule 6(1)(a)",
             "Name and address of the manufacturer, or of the manufacturer and packer if different, "
             "or of the importer, must be declared."),
    "R6-2": ("Rule 6(1)(aa)",
             "Country of origin/manufacture/assembly must be declared for imported products."),
    "R6-3": ("Rule 6(1)(b)",
             "The common or generic name of the commodity must be declared, plainly and conspicuously."),
    "R6-4": ("Rule 6(1)(c)",
             "Net quantity must be declared in the standard unit of weight, measure or number."),
    "R6-5": ("Rule 6(1)(d)",
             "Month and year in which the commodity was manufactured, pre-packed or imported must be declared."),
    "R6-6": ("Rule 6(1)(da)",
             "Best-before or use-by date must be declared for perishable/shelf-life-limited commodities."),
    "R6-7": ("Rule 6(1)(e)",
             "Retail sale price must be declared as MRP, inclusive of all taxes."),
    "R6-9": ("Rule 6(2)",
             "Name, address, telephone number and/or e-mail address of a person/office to contact "
             "for consumer complaints must be declared."),
    "R6-10": ("Rule 6 (as amended, 2023)",
              "Unit sale price (price per standard unit) must be declared, unless it equals the "
              "retail sale price or the package is a combination/group/multi-piece package."),
    "R6-11": ("Rule 12(6)",
              "The net quantity declaration must not contain any word or expression that tends to "
              "create an exaggerated, misleading or inadequate impression of quantity (e.g. "
              "'minimum', 'not less than', 'average', 'about', 'approximately')."),
    "R7-1": ("Rule 7(2), Table-I",
             "Numeral height for this declaration on the principal display panel must meet the "
             "minimum specified in Rule 7 Table-I, keyed to PDP area."),
    "R7-2": ("Rule 7(2), Table-I",
             "Numeral height for this declaration on the principal display panel must meet the "
             "minimum specified in Rule 7 Table-I, keyed to PDP area."),
    "R8-1": ("Rule 2(h), Rule 8(1)",
             "Every declaration required under Rule 6 must appear on the principal display panel — "
             "i.e. all mandatory declarations must be grouped together in one place, not scattered "
             "across visually separate areas of the package (Rule 2(h) definition + Rule 8(1))."),
    "R8-2": ("Rule 8(1), proviso",
             "The area surrounding the net quantity declaration must be free from other printed "
             "information: at least the numeral's own height above and below, and at least twice the "
             "numeral's height to the left and right (Rule 8(1), proviso)."),
}
MEDICAL_REFERENCE = "Rule 7(2), proviso (G.S.R. 778(E), 23.10.2025)"

# --- fixed values: result note texts ----------------------------------------------------------
NOTE_BOTH_READERS = "Read independently by both OCR and the vision model, in agreement."
NOTE_VISION_CONTESTED = "Read by the vision model; {note}. Verify against the package."
NOTE_VISION_ONLY = "Read by the vision model (OCR could not resolve this declaration)."
NOTE_DISAGREEMENT = "OCR read this as "
NOTE_NOT_FOUND = "Declaration not found on label."
NOTE_LOW_CONFIDENCE = "Low OCR confidence — verify manually."
NOTE_MAKER_MISSING = "Neither manufacturer name nor address found on label."
NOTE_MAKER_PARTIAL = "Only partial manufacturer details found (name or address missing) — verify manually."
NOTE_MAKER_LOW = "Low OCR confidence on manufacturer details — verify manually."
NOTE_DOMESTIC = "Product identified as domestic."
NOTE_IMPORT_UNKNOWN = "Import status could not be determined from the label — verify manually."
NOTE_QTY_MISSING = "Net quantity value not found on label."
NOTE_QTY_NO_UNIT = "Net quantity value found but unit not confidently identified — verify manually."
NOTE_LIQUID_COUNT = "Liquid commodity declared in count unit '{unit}' instead of volume — likely non-compliant."
NOTE_SOLID_COUNT = "Solid commodity declared in unit '{unit}' — confirm this is a legitimate count-sold category."
NOTE_NOT_PERISHABLE = "Commodity not identified as perishable category."
NOTE_PERISHABLE_UNKNOWN = ("Perishable-category status not determined — verify manually whether this "
                           "declaration applies.")
NOTE_MRP_MISSING = "MRP not found on label."
NOTE_TAX_MISSING = "MRP found but 'inclusive of all taxes' qualifier not found — required wording missing."
NOTE_CARE_MISSING = "No consumer care details found on label."
NOTE_CARE_PARTIAL = ("{n} of the 4 consumer-care details (name, address, phone, email) were read. It is not settled "
                     "here whether all of them must be printed; check by hand.")
NOTE_MULTIPIECE = "Combination/group/multi-piece package — exempt per 2023 amendment."
NOTE_UNIT_PRICE_MISSING = ("Unit sale price not found. Could be exempt (MRP == unit sale price) or missing — "
                           "package category not confidently enough determined to auto-FAIL. Verify manually.")
NOTE_NO_QTY_TO_CHECK = ("Net quantity declaration not located — nothing to check for misleading wording "
                        "(see R6-4 for whether the declaration itself is present).")
NOTE_MISLEADING = "Prohibited qualifying word(s) found in the net quantity declaration: {terms}."
LABEL_MRP_HEIGHT = "MRP numeral height"
LABEL_QTY_HEIGHT = "Net quantity numeral height"
NOTE_MEDICAL = ("The package holds a medical device. For these the proviso to Rule 7(2) (G.S.R. 778(E) of 23.10.2025) "
                "points to the Medical Devices Rules, 2017 in place of Table-I; their sizes are not checked here. "
                "Check them by hand.")
VALUE_HEIGHT = "{mm} mm (calibrated, Tier 2)"
NOTE_HEIGHT = "{label}: required >= {min} mm for PDP area {area} cm^2; measured {mm} mm."
NOTE_HEIGHT_NO_DATA = ("No calibration reference and insufficient text-height data to even produce a "
                       "relative signal — manual verification required.")
NOTE_HEIGHT_SMALL = ("Tier 1 (relative, uncalibrated): {label} is only {pct}% of the tallest text on the label "
                     "(typically the brand name) — disproportionately small text is a common violation "
                     "pattern, but this is a RELATIVE signal only, not a verified mm measurement against "
                     "Rule 7's table. Manual verification with a scale reference required for a definitive "
                     "Rule 7 finding.")
NOTE_HEIGHT_FINE = ("Tier 1 (relative, uncalibrated): {label} is {pct}% of the tallest text on the label — no "
                    "obvious disproportion detected, but this is not a calibrated mm measurement against "
                    "Rule 7's table. Provide a reference dimension for a Tier 2 calibrated check.")
NOTE_PROXY = ("Being on one panel is judged as a proxy only: by how near the boxes of the declarations lie in the flat "
              "photo, not by the package's real faces.")
NOTE_GROUP_FEW = "Fewer than 2 declarations located with position data — cannot assess grouping. "
NOTE_GROUP_NO_DIMS = "Image dimensions unavailable — cannot normalize distances. "
VALUE_GROUP_PASS = "max normalized spread {worst}%"
NOTE_GROUP_PASS = ("All {n} located declarations cluster tightly in the image (max distance from centroid: "
                   "{worst}% of image diagonal), consistent with a single principal display panel. ")
VALUE_GROUP_FAIL = "{name} at {worst}% of image diagonal from the rest"
NOTE_GROUP_FAIL = ("The '{name}' declaration is positioned far from where the other declarations cluster "
                   "({worst}% of the image diagonal away, vs. a typical spread of {median}%) — likely not on "
                   "the same principal display panel as the rest. ")
NOTE_GROUP_UNSURE = ("'{name}' is somewhat separated from the main cluster of declarations ({worst}% of image "
                     "diagonal) — not clearly a different panel, but not clearly the same one either. Manual "
                     "verification recommended. ")
NOTE_NUMERAL_APPROX = ("The height of the numerals is taken from the box of the whole text line, unit letters included, so "
                       "the space asked for is rather too wide than too narrow.")
NOTE_CLEAR_NO_QTY = "Net quantity declaration not located — clear-space compliance cannot be evaluated. "
NOTE_CLEAR_BAD_HEIGHT = "Invalid numeral height detected. "
NOTE_CLEAR_PASS = ("No other detected text encroaches on the required clear space around the net quantity "
                   "declaration. ")
NOTE_CLEAR_FAIL = ("Other printed text encroaches on the required clear space around the net quantity "
                   "declaration: {texts}. ")
GROUPED_DECLARATIONS = [
    ("manufacturer", "manufacturer_name"), ("common/generic name", "common_generic_name"),
    ("net quantity", "net_quantity_value"), ("mfg date", "mfg_month_year"), ("MRP", "mrp_value"),
    ("consumer care", "consumer_care_name"), ("country of origin", "country_of_origin"),
]
WARNING_NO_TEXT = ("No text was detected in this image at all. The FAIL results below likely mean the photo is "
                   "unreadable (blank, blurry, wrong item, or not a product label) — not that this product "
                   "fails every declaration. Retake the photo before treating this as an enforcement finding.")
WARNING_FEW_REGIONS = ("Only {n} short text region(s) were detected and none matched a recognizable "
                       "declaration. The FAILs below likely reflect a poor-quality or off-target photo rather "
                       "than a genuinely non-compliant label — verify with a clearer photo before treating "
                       "this as an enforcement finding.")
REASON_TOO_SMALL = ("Image resolution is too low to read reliably ({w}x{h}px, shorter side {s}px). Retake the "
                    "photo closer to the label, or at a higher resolution — the shorter side needs to be at "
                    "least {min}px.")
REASON_BLURRY = ("Image is too blurry to read reliably — the resolution is fine, but the photo looks out of "
                 "focus. Retake it with the label held steady and in focus.")
VERIFIED_NOTE = "Manually verified as compliant by {who} on {when} UTC (automated result: NEEDS_VERIFICATION)."
VERIFIER_NOTE = " Verifier's note: "
