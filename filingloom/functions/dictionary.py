"""Keyword dictionaries and other fixed tables."""

from __future__ import annotations

# Keyword groups by category, with their terms.
TRACKED = {
    "legal_regulatory": {
        "litigation": ["litigation", "lawsuit", "legal proceedings", "class action", "arbitration"],
        "regulatory": ["regulatory action", "SEC investigation", "consent decree", "compliance violation"],
        "sanctions": ["sanctions", "penalty", "fine", "enforcement action"],
        "antitrust": ["antitrust", "anti-competitive", "monopoly", "cartel"],
    },
    "financial_risk": {
        "liquidity": ["liquidity risk", "cash shortfall", "credit facility", "going concern"],
        "debt": ["debt covenant", "leverage ratio", "credit downgrade", "debt restructuring"],
        "impairment": ["goodwill impairment", "asset writedown", "restructuring charge"],
        "revenue_decline": ["revenue decline", "customer concentration", "contract termination"],
    },
    "operational": {
        "cybersecurity": ["cybersecurity", "data breach", "ransomware", "security incident"],
        "supply_chain": ["supply chain disruption", "supplier risk", "component shortage"],
        "workforce": ["layoff", "workforce reduction", "restructuring", "headcount"],
        "climate": ["climate risk", "carbon emissions", "environmental regulation"],
    },
    "strategic": {
        "competition": ["competitive pressure", "market share loss", "disruptive technology"],
        "acquisition": ["acquisition", "merger", "divestiture", "joint venture"],
        "ai_technology": ["artificial intelligence", "machine learning", "generative AI"],
    },
    "financial_strength": {
        "revenue_growth": ["revenue growth", "revenue increased", "strong demand", "record revenue"],
        "margin_expansion": ["margin improvement", "margin expansion", "operating leverage", "cost reduction"],
        "shareholder_returns": ["share repurchase", "stock buyback", "dividend increase", "capital return"],
        "innovation": ["new product", "product launch", "patent", "research and development"],
        "market_expansion": ["market expansion", "new market", "international growth", "customer acquisition"],
    },
}
BULLISH = ["acquisition", "ai_technology", "revenue_growth", "margin_expansion", "shareholder_returns", "innovation", "market_expansion"]

# Terms of a question and what may stand for them.
SYNONYMS = {
    "revenue": ["revenue", "sales", "top line", "turnover"],
    "profit": ["profit", "net income", "earnings", "bottom line"],
    "risk": ["risk factors", "risk", "uncertainty", "exposure"],
    "ai": ["artificial intelligence", "machine learning", "AI", "deep learning"],
    "debt": ["debt", "liabilities", "borrowings", "leverage"],
    "competition": ["competition", "competitors", "competitive landscape", "market share"],
}
FOLLOW_UPS = ["it", "that", "this", "they", "what about", "how about", "also", "and"]


def tracked() -> list[tuple[str, str, str]]:
    """``(group, term, polarity)`` of the tracked dictionary."""
    return [(g, t, "bull" if g in BULLISH else "bear") for groups in TRACKED.values() for g, terms in groups.items() for t in terms]


#: A dictionary over what filings of manufacturers talk about; the same code takes any.
INDUSTRIAL = [
    ("litigation", "litigation", "bear"), ("litigation", "settlement", "bear"), ("regulation", "regulation", "bear"), ("regulation", "tariff", "bear"),
    ("debt", "debt", "bear"), ("debt", "interest rate", "bear"), ("cybersecurity", "cybersecurity", "bear"), ("climate", "climate", "bear"),
    ("currency", "currency", "bear"), ("competition", "competition", "bear"), ("workforce", "strike", "bear"), ("workforce", "turnover", "bear"),
    ("closure", "close of", "bear"), ("supplier", "insolvency", "bear"), ("growth", "rose", "bull"), ("growth", "improved", "bull"),
    ("growth", "accelerated", "bull"), ("base", "larger installed base", "bull"), ("contracts", "new contracts", "bull"), ("price", "price list", "bull"),
    ("share", "higher share", "bull"), ("innovation", "patent", "bull"),
]
