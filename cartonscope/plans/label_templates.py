"""Layout templates used to derive label tables from the order/part/supplier tables.

Each row is (case, box number, text with {slots}, x, y, width, height). A label takes the template
``o_orderkey % CASES``; slots are filled from its part, supplier, nation and order date.
"""

# --- fixed values -----------------------------------------------------------------------------
CASES = 24
TEMPLATE = [
    (0, 0, "{name}", 60, 30, 380, 52),
    (0, 1, "Net Weight: {qty} g", 60, 120, 210, 24),
    (0, 2, "Packed by {maker}, Mill Road, {nation}", 60, 175, 430, 24),
    (0, 3, "Packed on {month}", 60, 230, 190, 22),
    (0, 4, "Helpline {phone} or desk{qty}@{digits5}.example.net, {nation}", 60, 285, 520, 22),
    (0, 5, "Retail Price Rs. {price} inclusive of all taxes", 1240, 980, 340, 24),
    (1, 0, "ઉત્પાદક: {maker}, સુરત 395003", 45, 35, 420, 28),
    (1, 1, "{name}", 45, 110, 360, 56),
    (1, 2, "ચોખ્ખું વજન {qty} ml", 45, 205, 230, 26),
    (1, 3, "પેકિંગ તારીખ {month}", 45, 270, 240, 26),
    (1, 4, "મહત્તમ છૂટક કિંમત રૂ. {price} તમામ કરવેરા સહિત", 45, 335, 470, 26),
    (1, 5, "ગ્રાહક સંભાળ: {phone}, desk{qty}@{digits5}.example.net", 45, 400, 520, 26),
    (2, 0, "{name}", 80, 24, 340, 48),
    (2, 1, "Price Rs. {price} incl of all taxes", 80, 105, 300, 22),
    (2, 2, "Contents {qty} g", 80, 160, 170, 22),
    (2, 3, "Packing date {month}", 80, 215, 220, 22),
    (2, 4, "Marketed by {maker}, {nation}", 80, 270, 360, 22),
    (2, 5, "Toll free {phone}", 80, 325, 230, 22),
    (3, 0, "{name}", 40, 26, 520, 60),
    (3, 1, "Net Quantity: {qty} g", 40, 125, 230, 26),
    (3, 2, "MRP ₹ {price} inclusive of all taxes", 330, 125, 360, 26),
    (3, 3, "Pkd on {month}", 40, 190, 180, 24),
    (3, 4, "Marketed by {maker}, Lake View, {nation}", 330, 190, 400, 24),
    (3, 5, "Customer Care {phone}, desk{qty}@{digits5}.example.net, {nation}", 40, 255, 560, 24),
    (4, 0, "Packed by {maker}, {nation}", 30, 40, 360, 22),
    (4, 1, "{name}", 30, 100, 330, 54),
    (4, 2, "MRP Rs. {price} including all taxes", 30, 190, 320, 24),
    (4, 3, "Contents: {qty} pcs", 30, 250, 190, 24),
    (4, 4, "Packed on {month}", 30, 310, 200, 22),
    (4, 5, "Helpline {phone}", 30, 370, 220, 22),
    (5, 0, "Net Weight {qty} g", 55, 30, 200, 26),
    (5, 1, "{name}", 55, 95, 310, 58),
    (5, 2, "Customer Care {phone}", 55, 190, 260, 24),
    (5, 3, "Packed on {month}", 55, 250, 200, 24),
    (5, 4, "Packed by {maker}, {nation}", 55, 310, 370, 24),
    (6, 0, "{name}", 70, 34, 350, 50),
    (6, 1, "शुद्ध मात्रा {qty} g", 70, 120, 220, 28),
    (6, 2, "अधिकतम खुदरा मूल्य रु. {price} सभी करों सहित", 70, 185, 450, 28),
    (6, 3, "पैकिंग तिथि {month}", 70, 250, 230, 28),
    (6, 4, "निर्माता: {maker}, जयपुर 302001", 70, 315, 400, 28),
    (6, 5, "उपभोक्ता देखभाल: {phone}, desk{qty}@{digits5}.example.net", 70, 380, 520, 28),
    (7, 0, "{name}", 35, 28, 340, 46),
    (7, 1, "Helpline {phone}, desk{qty}@{digits5}.example.net", 35, 110, 460, 22),
    (7, 2, "Packed by {maker}, {nation}", 35, 165, 370, 22),
    (7, 3, "MRP Rs. {price} including all taxes", 35, 220, 320, 22),
    (7, 4, "Net Weight {qty} g", 35, 275, 200, 22),
    (8, 0, "{name}", 50, 30, 480, 72),
    (8, 1, "Packed on {month}", 50, 140, 210, 26),
    (8, 2, "MRP Rs. {price} including all taxes", 50, 205, 190, 9),
    (8, 3, "Net Weight {qty} g", 50, 255, 220, 26),
    (8, 4, "Marketed by {maker}, {nation}", 50, 320, 380, 26),
    (8, 5, "For complaints: desk{qty}@{digits5}.example.net", 50, 385, 430, 26),
    (9, 0, "MRP Rs. {price} including all taxes", 65, 30, 330, 24),
    (9, 1, "{name}", 65, 90, 320, 52),
    (9, 2, "Contents {qty} kg", 65, 180, 190, 24),
    (9, 3, "Helpline {phone}", 65, 240, 220, 24),
    (9, 4, "Packing date {month}", 65, 300, 230, 24),
    (10, 0, "{name}", 90, 26, 360, 50),
    (10, 1, "Packed by {maker}, {nation}", 90, 110, 370, 22),
    (10, 2, "Net Volume {qty} l", 90, 165, 200, 22),
    (10, 3, "Packed on {month}", 90, 220, 200, 22),
    (10, 4, "MRP Rs. {price} including all taxes", 90, 275, 330, 22),
    (11, 0, "ग्राहक सेवा: {phone}", 75, 30, 270, 26),
    (11, 1, "{name}", 75, 95, 330, 54),
    (11, 2, "Net Quantity {qty} g", 75, 185, 230, 26),
    (11, 3, "કિંમત રૂ. {price} તમામ કરવેરા સહિત", 75, 250, 430, 26),
    (11, 4, "ઉત્પાદન તારીખ {month}", 75, 315, 250, 26),
    (11, 5, "द्वारा पैक {maker}, नागपुर 440001", 75, 380, 390, 26),
    (12, 0, "{name}", 900, 1500, 640, 110),
    (12, 1, "INET QTY", 930, 1700, 240, 74),
    (12, 2, "{qty}", 1500, 1680, 82, 60),
    (12, 3, "g", 1605, 1690, 36, 60),
    (12, 4, "PKD", 930, 1900, 120, 66),
    (12, 5, "9/04/26", 1510, 1890, 170, 44),
    (12, 6, "EXPIRY", 925, 2020, 205, 80),
    (12, 7, "{date}", 1500, 1990, 230, 52),
    (12, 8, "M.R.P.", 930, 2180, 160, 70),
    (12, 9, "Rs. {price}", 1520, 2170, 230, 60),
    (12, 10, "Marketed by {maker}", 900, 2400, 760, 60),
    (13, 0, "{name}", 30, 10, 310, 44),
    (13, 1, "INET QTY {qty} g", 30, 100, 200, 22),
    (13, 2, "Markoted by {maker}", 30, 180, 300, 22),
    (13, 3, "MRP ₹{price} incl of a1l taxes", 30, 260, 250, 22),
    (13, 4, "PKD. 1{month}", 30, 340, 160, 22),
    (13, 5, "EXPIRY. {date}", 30, 420, 160, 22),
    (14, 0, "{name}", 25, 20, 280, 36),
    (14, 1, "Net Vol {qty} mi", 25, 100, 180, 18),
    (14, 2, "Lic. No. 2004415000377", 25, 170, 260, 18),
    (14, 3, "2004415000377", 25, 240, 200, 18),
    (14, 4, "1800 205 7788", 25, 310, 200, 18),
    (14, 5, "write to hello@{qty}shop.example.org today", 25, 380, 330, 18),
    (14, 6, "or sales@shop.example.com", 25, 450, 330, 18),
    (15, 0, "{name}", 20, 20, 300, 40),
    (15, 1, "Net Wt. approx. {qty} g minimum", 20, 110, 300, 20),
    (15, 2, "MRP Rs. 1,{qty}.50", 20, 195, 250, 20),
    (15, 3, "Best Before 12 months from packing", 20, 280, 300, 20),
    (15, 4, "Packed by {maker}", 20, 365, 300, 20),
    (16, 0, "{name}", 20, 20, 300, 40),
    (16, 1, "Net Weight ३६० g", 20, 110, 150, 20),
    (16, 2, "MRP Rs. ૪૭ including all taxes", 20, 195, 250, 20),
    (16, 3, "Net Weight ૩૬૦ g", 20, 280, 150, 20),
    (16, 4, "પેકિંગ તારીખ {date}", 20, 365, 250, 20),
    (18, 0, "xkq7", 15, 40, 60, 14),
    (18, 1, "###", 200, 90, 30, 9),
    (19, 0, "{name}", 20, 20, 300, 40),
    (19, 1, "Net Wt. {qty} g", 100, 200, 150, 20),
    (19, 2, "batch no. {qty}{qty}", 100, 185, 200, 20),
    (19, 3, "Shelf", 280, 205, 60, 12),
    (19, 4, "tuck", 110, 236, 60, 12),
    (19, 5, "flap", 60, 170, 30, 9),
    (19, 6, "edge", 100, 240, 30, 11),
    (20, 0, "{name}", 20, 20, 300, 40),
    (20, 1, "{name} deluxe", 20, 90, 300, 40),
    (20, 2, "Price Rs. {price}", 20, 160, 200, 20),
    (20, 3, "MRP Rs. 999", 20, 230, 200, 20),
    (20, 4, "Contents: {qty} pcs", 20, 300, 200, 20),
    (20, 5, "Net Qty 5 nos", 20, 370, 200, 20),
    (20, 6, "Mfd. {date}", 20, 440, 200, 20),
    (20, 7, "Expiry", 20, 510, 100, 20),
    (20, 8, "{month}", 150, 514, 90, 18),
    (20, 9, "{date}", 270, 506, 110, 18),
    (21, 0, "{name}", 20, 20, 300, 40),
    (21, 1, "Country of Origin: {nation}", 20, 90, 260, 20),
    (21, 2, "Imported and marketed by {maker}", 20, 160, 300, 20),
    (21, 3, "Unit Sale Price Rs. 0.62/g", 20, 230, 260, 20),
    (21, 4, "Net Quantity: {qty} g", 20, 300, 200, 20),
    (21, 5, "MRP {price}/- inclusive of all taxes", 20, 370, 260, 20),
    (21, 6, "Packing date Jan 2026", 20, 440, 200, 20),
    (21, 7, "Use by", 20, 510, 80, 20),
    (21, 8, "see lid of {name}", 620, 510, 120, 20),
    (21, 9, "Customer care: call 98765{digits5} or help@shop.example.com", 20, 580, 400, 20),
    (22, 0, "{name}", 20, 20, 300, 40),
    (22, 1, "Manufactured by {maker}", 20, 110, 350, 20),
    (22, 2, "Net Qty {qty} ml", 20, 195, 150, 20),
    (22, 3, "MRP Rs. {price} inclusive of all taxe", 20, 280, 250, 20),
    (22, 4, "Helpline {phone}", 20, 365, 250, 20),
    (22, 5, "Made in {nation}", 20, 450, 200, 20),
    (23, 0, "{qty}+19 people asked (survey, 2021)", 20, 20, 400, 22),
    (23, 1, "ooll730l", 20, 90, 90, 22),
    (23, 2, "Consumer Care Lic. No. 2004415000377", 20, 160, 350, 22),
    (23, 3, "{qty} gm pouch", 20, 230, 150, 22),
    (23, 4, "NET QTY", 90, 700, 240, 70),
    (23, 5, "640 kg", 2900, 700, 190, 60),
]
# (category, imported, perishable, medical, multipiece) known from the catalogue, None = unknown
CATALOGUE = {
    0: ("solid", False, False, None, None), 1: ("liquid", False, False, None, None),
    2: ("solid", True, False, None, None), 3: ("solid", False, False, None, None),
    4: ("liquid", False, False, None, None), 5: ("solid", False, False, None, None),
    6: ("solid", False, False, None, None), 7: ("solid", False, False, None, None),
    8: ("solid", False, False, None, None), 9: ("solid", False, False, None, None),
    10: ("liquid", False, False, None, None), 11: ("solid", True, False, None, None),
    12: (None, None, None, None, None), 13: (None, None, None, False, None),
    14: (None, None, False, None, None), 15: ("solid", False, None, None, True),
    16: ("solid", None, True, None, None), 17: (None, None, None, None, None),
    18: (None, None, None, None, None), 19: ("solid", False, False, False, False),
    20: ("solid", None, None, None, True), 21: (None, None, None, None, False),
    22: (None, None, True, True, None), 23: ("", None, None, None, None),
}
# (case, rule, status) every derived label of that case must reach
COMPLETE = ["R6-1", "R6-3", "R6-4", "R6-5", "R6-7", "R6-9", "R8-1", "R8-2"]
EXPECTED = [
    *((case, rule, "PASS") for case in (1, 3, 6) for rule in COMPLETE),
    (0, "R8-1", "FAIL"), (0, "R6-9", "PASS"), (2, "R6-2", "FAIL"), (2, "R6-7", "PASS"), (4, "R6-4", "FAIL"),
    (4, "R6-1", "PASS"), (5, "R6-7", "FAIL"), (5, "R6-4", "PASS"), (7, "R6-5", "FAIL"), (7, "R6-9", "PASS"),
    (8, "R7-1", "NEEDS_VERIFICATION"), (9, "R6-1", "FAIL"), (10, "R6-9", "FAIL"), (10, "R6-4", "PASS"),
    (11, "R6-2", "FAIL"), (11, "R6-9", "NEEDS_VERIFICATION"), (11, "R6-5", "PASS"),
]


def image_size(case: int) -> tuple[int, int]:
    """Extent of the case's boxes plus a margin, at least 460 x 260."""
    boxes = [r for r in TEMPLATE if r[0] == case]
    return (max([460] + [x + w + 20 for _, _, _, x, _, w, _ in boxes]),
            max([260] + [y + h + 20 for _, _, _, _, y, _, h in boxes]))
