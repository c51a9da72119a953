"""A four-page manual and its machine's parts, as page text. The words and their order on the pages."""

import textwrap

HEAD, FOOT, FIRST_PAGE, COLUMN = "SECTION 4 - SHORT BLOCK ASSEMBLY", "TEST FIXTURE - NOT AN OEM MANUAL", 41, 92
BLOCKS = [
    [
        "Preparation",
        "Before assembly, wash all components in clean solvent and blow dry. Inspect the bores and journals for scoring. Replace any component outside the service limits given in Section 2.",
        "4.1 Crankcase and crankshaft",
        "1. Mount the crankcase on the engine stand with the cylinder deck facing up and the sump opening clear of the stand arm.",
        "2. Lubricate the main journals with clean engine oil and lay the crankshaft into the case, seating it fully in both main bearings.",
        "3. Install the camshaft, aligning the punch mark on the cam gear with the corresponding mark on the crank gear. WARNING: mis-timed valves will contact the piston on the first rotation.",
        "4. Rotate the crankshaft two full turns by hand and confirm it turns freely with no binding before continuing.",
    ],
    [
        "4.2 Connecting rod",
        "5. Position the connecting rod on the crank pin with the oil dipper facing the camshaft side of the case.",
        "6. Fit the connecting rod cap, matching the alignment marks stamped on the rod and the cap. The marks must be on the same side.",
        "7. Tighten the connecting rod bolts to 12 N.m in two even stages using a torque wrench. Do not exceed the specified figure.",
        "4.3 Cylinder and piston",
        "8. Fit the cylinder barrel to the crankcase deck and draw it down evenly onto the register.",
        "9. Fit the three compression rings to the piston with the ring gaps staggered at 120 degrees, using a ring expander.",
        "10. Compress the rings and slide the piston into the bore, then connect it to the connecting rod with the wrist pin and fit new circlips.",
    ],
    [
        "4.4 Valve train",
        "11. Lap the intake valve into its seat until a continuous grey band is visible around the full circumference of the face.",
        "12. Lap the exhaust valve into its seat using the same method. The exhaust valve runs hotter and must seat perfectly.",
        "13. Fit the valve springs and retainers, compressing each spring with a valve spring compressor to seat the keepers.",
        "4.5 Cylinder head",
        "14. Place a new cylinder head gasket on the deck, dry. CAUTION: do not reuse the old gasket and do not apply sealant.",
        "15. Lower the cylinder head onto the gasket without disturbing it, locating it on the two dowels.",
        "16. Tighten the cylinder head bolts to 24 N.m (17.7 lb-ft) in a crossing pattern, in two stages. Uneven torque will distort the deck.",
    ],
    [
        "4.6 Final assembly",
        "17. Fit the spark plug and tighten to 18 N.m. Check the electrode gap before fitting.",
        "18. Fit the flywheel to the tapered crank end, ensuring the key is fully seated, and tighten the nut to 75 N.m with a torque wrench.",
        "Torque reference",
        "Connecting rod bolt          12 N.m",
        "Cylinder head bolt           24 N.m",
        "Spark plug                   18 N.m",
        "Flywheel nut                 75 N.m",
    ],
]
#: part id, name, forms, what it goes onto
SEED = [
    ("crankcase", "Crankcase", ["crankcase", "crank case", "cylinder block"], []),
    ("crankshaft", "Crankshaft", ["crankshaft", "crank shaft"], ["crankcase"]),
    ("camshaft", "Camshaft assembly", ["camshaft", "cam shaft", "cam gear"], ["crankcase"]),
    ("connecting_rod", "Connecting rod", ["connecting rod", "conrod", "con rod"], ["crankshaft"]),
    ("rod_cap", "Connecting rod cap", ["connecting rod cap", "rod cap", "big end cap"], ["connecting_rod"]),
    ("rod_bolt", "Connecting rod bolt", ["connecting rod bolt", "rod bolt", "big end bolt"], ["rod_cap"]),
    ("cylinder_barrel", "Cylinder barrel", ["cylinder barrel", "cylinder bore", "barrel", "bore"], ["crankcase"]),
    ("piston", "Piston", ["piston"], []),
    ("piston_ring", "Piston ring set", ["piston ring", "compression ring", "ring set", "rings"], ["piston"]),
    ("wrist_pin", "Wrist pin", ["wrist pin", "gudgeon pin", "piston pin"], ["piston", "connecting_rod"]),
    ("intake_valve", "Intake valve", ["intake valve", "inlet valve"], []),
    ("exhaust_valve", "Exhaust valve", ["exhaust valve"], []),
    ("valve_spring", "Valve spring", ["valve spring", "spring and retainer"], ["intake_valve", "exhaust_valve"]),
    ("head_gasket", "Cylinder head gasket", ["cylinder head gasket", "head gasket", "gasket"], ["cylinder_barrel"]),
    ("cylinder_head", "Cylinder head", ["cylinder head", "head"], ["head_gasket"]),
    ("head_bolt", "Cylinder head bolt", ["cylinder head bolt", "head bolt"], ["cylinder_head"]),
    ("spark_plug", "Spark plug", ["spark plug", "sparking plug", "plug"], ["cylinder_head"]),
    ("flywheel", "Flywheel", ["flywheel", "fly wheel"], ["crankshaft"]),
]
TOOLS = ["torque wrench", "ring compressor", "ring expander", "valve spring compressor", "feeler gauge", "plug socket", "flywheel puller", "dial indicator", "micrometer"]


def pages():
    """(page, text) with a running head, the blocks wrapped at the column, a folio and a foot."""
    for n, blocks in enumerate(BLOCKS):
        lines = [HEAD, *[line for b in blocks for line in (textwrap.wrap(b, COLUMN) if b[0].isdigit() and b[1] in "0123456789." and b[2] != "." and b[:3].strip().rstrip(".").isdigit() or b.startswith("Before") else [b])], f"4-{n + 1}", FOOT]
        yield n + 1, "\n".join(lines)
