"""Five invented business documents with what a reader finds in them."""

CARD = """CREDIT CARD STATEMENT
Account Holder: Nora B. Whitfield
Card Number: **** **** **** 7310
Statement Date: March 4, 2023
Previous Balance $1,204.66
Purchases $310.00
New Balance $310.00
Recent Transactions
02/03/2023 Grocer purchases $44.10
Customer Service: 1-800-555-0142
Email: help@plumcard.example
SSN on File: ***-**-1188
"""
BANK = """MONTHLY BANK STATEMENT
Account Holder: Tomas Field
Account Number: ****-****-0042
Routing Number: 091000019
Beginning Balance $9,001.10
Total Deposits $12.00
Ending Balance $9,013.10
Grove National Bank
77 Birch Avenue, Lake City, MN 55041
Phone: (507) 555-0101
Email: t.field@mail.example
Tax ID: 41-7654321
"""
PORTFOLIO = """INVESTMENT PORTFOLIO STATEMENT
Name: Iris K. Moreau
Account Number: INV-2021-004417
SSN: ***-**-2200
Address: 9 Cedar Lane, Boise, ID 83702
Stocks 60.5%
Bonds 39.5%
Advisor: Paul Q. Reyes
Phone: (208) 555-0119
Email: p.reyes@northfund.example
"""
MORTGAGE = """RESIDENTIAL MORTGAGE STATEMENT
Primary Borrower: Dana Quill
Co-Borrower: Sam R. Quill
Property Address: 12 Maple Street, Salem, OR 97301
Loan Number: MTG-2018-118822
Interest rate 3.875%
Principal payment $812.44
Credit Score: 742
Annual Income: $84,000
Driver's License: Q4471120
"""
INSURANCE = """LIFE INSURANCE POLICY DECLARATION
Policy Number: LIFE-2020-556611
Name: Ada Lindqvist
Date of Birth: May 9, 1979
Death benefit coverage $250,000.00
Primary: Omar Lindqvist (Spouse) - 100%
Beacon Mutual Insurance Company
"""

# name, text, category, entities (type, value), pii (type, value, replacement)
SAMPLES = [
    (
        "card.txt", CARD, "Banking Statement",
        [
            ("person", "Nora B. Whitfield"), ("account_number", "**** **** **** 7310"), ("ssn_tax_id", "***-**-1188"),
            ("amount", "$1,204.66"), ("amount", "$310.00"), ("amount", "$310.00"), ("amount", "$44.10"),
            ("date", "March 4, 2023"), ("date", "02/03/2023"), ("email", "help@plumcard.example"),
            ("phone", "1-800-555-0142"),
        ],
        [
            ("person", "Nora B. Whitfield", "[REDACTED]"), ("ssn", "***-**-1188", "***-**-1188"),
            ("account_number", "**** **** **** 7310", "**** **** **** 7310"),
            ("email", "help@plumcard.example", "[REDACTED]"), ("phone", "1-800-555-0142", "*-***-***-0142"),
            ("financial_account_details", "$1,204.66", "$1000+"), ("financial_account_details", "$310.00", "$100+"),
        ],
    ),
    (
        "bank.txt", BANK, "Banking Statement",
        [
            ("person", "Tomas Field"), ("organization", "Grove National Bank"), ("account_number", "****-****-0042"),
            ("ssn_tax_id", "41-7654321"), ("amount", "$9,001.10"), ("amount", "$12.00"), ("amount", "$9,013.10"),
            ("address", "77 Birch Avenue, Lake City, MN 55041"), ("email", "t.field@mail.example"),
            ("phone", "(507) 555-0101"),
        ],
        [
            ("person", "Tomas Field", "[REDACTED]"), ("tax_id", "41-7654321", "**-***4321"),
            ("account_number", "****-****-0042", "****-****-0042"), ("routing_number", "091000019", "*****0019"),
            ("email", "t.field@mail.example", "[REDACTED]"), ("phone", "(507) 555-0101", "(***) ***-0101"),
            ("address", "77 Birch Avenue, Lake City, MN 55041", "MN 55041"),
            ("financial_account_details", "$9,001.10", "$1000+"), ("financial_account_details", "$9,013.10", "$1000+"),
        ],
    ),
    (
        "portfolio.txt", PORTFOLIO, "Investment Document",
        [
            ("person", "Iris K. Moreau"), ("person", "Paul Q. Reyes"), ("account_number", "INV-2021-004417"),
            ("ssn_tax_id", "***-**-2200"), ("amount", "60.5%"), ("amount", "39.5%"),
            ("address", "9 Cedar Lane, Boise, ID 83702"), ("email", "p.reyes@northfund.example"),
            ("phone", "(208) 555-0119"),
        ],
        [
            ("person", "Iris K. Moreau", "[REDACTED]"), ("person", "Paul Q. Reyes", "[REDACTED]"),
            ("ssn", "***-**-2200", "***-**-2200"), ("account_number", "INV-2021-004417", "***-****-**4417"),
            ("email", "p.reyes@northfund.example", "[REDACTED]"), ("phone", "(208) 555-0119", "(***) ***-0119"),
            ("address", "9 Cedar Lane, Boise, ID 83702", "ID 83702"),
        ],
    ),
    (
        "mortgage.txt", MORTGAGE, "Loan Application",
        [
            ("person", "Dana Quill"), ("person", "Sam R. Quill"), ("account_number", "MTG-2018-118822"),
            ("amount", "$812.44"), ("amount", "$84,000"), ("amount", "3.875%"),
            ("address", "12 Maple Street, Salem, OR 97301"), ("credit_score", "742"),
            ("property", "12 Maple Street, Salem, OR 97301"),
        ],
        [
            ("person", "Dana Quill", "[REDACTED]"), ("person", "Sam R. Quill", "[REDACTED]"),
            ("account_number", "MTG-2018-118822", "***-****-**8822"), ("drivers_license", "Q4471120", "[REDACTED]"),
            ("address", "12 Maple Street, Salem, OR 97301", "OR 97301"), ("salary_income", "$84,000", "$10000+"),
            ("credit_score", "742", "[REDACTED]"),
        ],
    ),
    (
        "insurance.txt", INSURANCE, "Insurance Policy",
        [
            ("person", "Ada Lindqvist"), ("person", "Omar Lindqvist"),
            ("organization", "Beacon Mutual Insurance Company"), ("account_number", "LIFE-2020-556611"),
            ("amount", "$250,000.00"), ("amount", "100%"), ("date", "May 9, 1979"),
        ],
        [
            ("person", "Ada Lindqvist", "[REDACTED]"), ("person", "Omar Lindqvist", "[REDACTED]"),
            ("account_number", "LIFE-2020-556611", "****-****-**6611"), ("date_of_birth", "May 9, 1979", "1979"),
        ],
    ),
]
