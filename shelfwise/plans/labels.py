"""Output labels and texts of the analyses.

Fixed values: these strings must equal the original statements' output
literally, so they are listed here plainly, in the order the statements test
them (first matching condition first, the fallback last).
"""

# q01 stock status
STOCK_STATUS = ("OUT OF STOCK", "CRITICAL LOW", "LOW STOCK", "ADEQUATE")

# q07 product velocity
VELOCITY = ("HIGH VELOCITY", "MEDIUM VELOCITY", "LOW VELOCITY")

# q08 movement category and recommendation
MOVEMENT = ("FAST MOVING", "MODERATE MOVING", "SLOW MOVING", "NOT MOVING")
TURNOVER_ADVICE = ("INCREASE STOCK", "REDUCE STOCK", "MAINTAIN CURRENT LEVELS")

# q15 trend direction
TREND = ("GROWING", "DECLINING", "STABLE")

# q16 day type
DAY_TYPE = ("HOLIDAY/PROMOTION", "REGULAR")

# q20 classes and q21 management strategy per class
ABC_CLASSES = ("A", "B", "C")
ABC_STRATEGY = {
    "A": "TIGHT CONTROL - Daily monitoring, safety stock",
    "B": "MODERATE CONTROL - Weekly monitoring",
    "C": "LOOSE CONTROL - Monthly review, minimize stock",
}

# q23 affinity strength and bundle type
AFFINITY = ("STRONG AFFINITY", "MODERATE AFFINITY", "WEAK AFFINITY")
BUNDLE = ("Cross-Category Opportunity", "Same Category Bundle")

# q24 performance rating
PERFORMANCE = ("EXCELLENT", "GOOD", "AVERAGE", "NEEDS IMPROVEMENT")

# q25 actions in priority order, and the advice for each (the last is the fallback)
ACTIONS = ("URGENT_RESTOCK", "INCREASE_STOCK", "REDUCE_STOCK", "CONSIDER_DISCONTINUE", "MAINTAIN")
ADVICE = {
    "URGENT_RESTOCK": "Order immediately to prevent lost sales",
    "INCREASE_STOCK": "Increase inventory levels to prevent stockouts",
    "REDUCE_STOCK": "Liquidate or transfer excess stock",
    "CONSIDER_DISCONTINUE": "Evaluate product viability for this location",
}
DEFAULT_ADVICE = "Current stock levels are appropriate"

# q26 supplier rating and action
SUPPLIER_RATING = ("EXCELLENT", "GOOD", "NEEDS IMPROVEMENT", "POOR")
SUPPLIER_ACTION = ("FIND ALTERNATIVE SUPPLIERS", "NEGOTIATE BETTER TERMS", "MAINTAIN RELATIONSHIP")
