"""Texts and findings whose results are known from reading; the library itself uses others."""

# Texts and the categories that are expected in them.
COVERAGE = [
    (1, "My name is Arun Sharma, I am 28 years old, Male, and my email is arun.sharma@hdfc.com", "FULLNAME,AGE,GENDER,EMAIL"),
    (2, "Contact me at +91-9876543210 or visit 123 MG Road, Mumbai 400001", "TELEPHONENUM,BUILDINGNUM,STREET,CITY,ZIPCODE"),
    (3, "PAN: AAAPA1234A, Aadhaar: 1234 5678 9012, Voter ID: ABC1234567", "PAN,AADHAAR,VOTERID"),
    (4, "Account: 123456789, IFSC: HDFC0001234, Credit Card: 4111 1111 1111 1111", "ACCOUNTNUM,IFSC,CREDITCARDNUM"),
    (5, "Passport: K1234567, Driver License: MH-14-2011-0062821", "PASSPORTNUM,DRIVERLICENSENUM"),
    (6, "Transaction ID: f47ac10b-58cc-4372-a567-0e02b2c3d479, Date: 15/08/2024, Time: 14:30", "TRANSACTIONID,DATE,TIME"),
    (7, "Name: Neha Mehta, Phone: 9876543210, Address: 456 Park Avenue, City: Bangalore", "FULLNAME,TELEPHONENUM,STREET,CITY"),
    (8, "Ravi Kumar Singh and Priya Sharma are colleagues", "FULLNAME"),
    (9, "Customer: Deepak Verma, DOB: 04-08-1990, Age: 34, Gender: M", "FULLNAME,DATE,AGE,GENDER"),
    (10, "Account Holder: Sunil Agarwal, Account Number: 001234567890123456, IFSC Code: SBIN0004567, Transaction: f47ac10b-58cc-4372-a567-0e02b2c3d479", "FULLNAME,ACCOUNTNUM,IFSC,TRANSACTIONID"),
]

# Findings to validate: category, word, score.
CASES = [
    ("FULLNAME", "John Doe", 0.95), ("GIVENNAME", "John", 0.9), ("SURNAME", "Doe", 0.9), ("TELEPHONENUM", "9876543210", 0.95), ("TELEPHONENUM", "+91-9876543210", 0.95),
    ("EMAIL", "john.doe@example.com", 0.95), ("CITY", "Mumbai", 0.9), ("ZIPCODE", "110001", 0.9), ("BUILDINGNUM", "123", 0.85), ("PAN", "AAAPA1234A", 0.95),
    ("AADHAAR", "1234 5678 9012", 0.95), ("VOTERID", "ABC1234567", 0.95), ("DRIVERLICENSENUM", "MH-14-2011-0062821", 0.95), ("PASSPORTNUM", "K1234567", 0.95),
    ("ACCOUNTNUM", "123456789", 0.9), ("IFSC", "HDFC0001234", 0.9), ("CREDITCARDNUM", "4111 1111 1111 1111", 0.9), ("DATE", "04/08/2024", 0.9), ("TIME", "12:25", 0.9),
    ("AGE", "28", 0.9), ("GENDER", "Male", 0.9), ("TRANSACTIONID", "f47ac10b-58cc-4372-a567-0e02b2c3d479", 0.9), ("DRIVERLICENSENUM", "AAAPA1234A", 0.95),
    ("AADHAAR", "9876543210", 0.95), ("CITY", "Mobile", 0.6), ("STREET", "1234-5678-9012", 0.9), ("DATE", "1234 - 5678 -", 0.903), ("AADHAAR", "9012", 0.702),
    ("DRIVERLICENSENUM", "ABCDE1234F", 0.854), ("TELEPHONENUM", "Mobile", 0.4), ("DATE", "123456", 0.9), ("DATE", "123456789", 0.9), ("DATE", "New Delhi", 0.9),
    ("DATE", "new delhi", 0.9), ("DATE", "28", 0.3), ("IBAN", "x", 0.9),
]
