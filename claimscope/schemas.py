"""Declared schemas of the five reference tables.

The claims file lists its columns in another order than the table does, so the
file order is kept apart from the typed table schema.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

from claimscope.constants import LAND_CLASSES

_SIMPLE = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def columns(text: str) -> T.StructType:
    """A schema from ``name type, name type``; unlike a DDL string it needs no session."""
    fields = []
    for name, kind, precision, scale in re.findall(r"(\w+) (\w+)(?:\((\d+),(\d+)\))?", text):
        dtype = T.DecimalType(int(precision), int(scale)) if precision else _SIMPLE[kind]
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


# --- fixed values: claims table, in table order ------------------------------
CLAIMS_DDL = """
asOfDate timestamp_ntz, amountPaidOnBuildingClaim decimal(12,2),
amountPaidOnContentsClaim decimal(12,2),
amountPaidOnIncreasedCostOfComplianceClaim decimal(12,2),
netBuildingPaymentAmount decimal(12,2), netContentsPaymentAmount decimal(12,2),
agricultureStructureIndicator boolean, basementEnclosureCrawlspaceType smallint,
policyCount smallint, crsClassificationCode smallint, dateOfLoss timestamp_ntz,
elevatedBuildingIndicator boolean, elevationCertificateIndicator string,
elevationDifference int, baseFloodElevation decimal(6,1), ratedFloodZone string,
houseWorship boolean, locationOfContents smallint, lowestAdjacentGrade decimal(6,1),
lowestFloorElevation decimal(6,1), numberOfFloorsInTheInsuredBuilding smallint,
nonProfitIndicator boolean, obstructionType smallint, occupancyType smallint,
originalConstructionDate date, originalNBDate date,
postFIRMConstructionIndicator boolean, rateMethod string,
smallBusinessIndicatorBuilding boolean, totalBuildingInsuranceCoverage int,
totalContentsInsuranceCoverage int, yearOfLoss smallint,
primaryResidenceIndicator boolean, buildingDamageAmount int,
buildingDeductibleCode string, buildingPropertyValue int, causeOfDamage string,
condominiumCoverageTypeCode string, contentsDamageAmount int,
contentsDeductibleCode string, contentsPropertyValue int,
disasterAssistanceCoverageRequired smallint, eventDesignationNumber string,
ficoNumber smallint, floodCharacteristicsIndicator smallint,
floodWaterDuration smallint, floodproofedIndicator boolean, floodEvent string,
iccCoverage int, netIccPaymentAmount decimal(8,2), nfipRatedCommunityNumber string,
nfipCommunityNumberCurrent string, nfipCommunityName string,
nonPaymentReasonContents string, nonPaymentReasonBuilding string,
numberOfUnits smallint, buildingReplacementCost bigint, contentsReplacementCost int,
replacementCostBasis string, stateOwnedIndicator boolean, waterDepth smallint,
floodZoneCurrent string, buildingDescriptionCode smallint,
rentalPropertyIndicator boolean, state string, reportedCity string,
reportedZipCode string, countyCode string, censusTract string,
censusBlockGroupFips string, latitude decimal(9,1), longitude decimal(9,1), id string
"""

# --- fixed values: claims columns, in the order the raw file lists them -------
CLAIMS_FILE_ORDER = """
agricultureStructureIndicator asOfDate basementEnclosureCrawlspaceType policyCount
crsClassificationCode dateOfLoss elevatedBuildingIndicator
elevationCertificateIndicator elevationDifference baseFloodElevation ratedFloodZone
houseWorship locationOfContents lowestAdjacentGrade lowestFloorElevation
numberOfFloorsInTheInsuredBuilding nonProfitIndicator obstructionType occupancyType
originalConstructionDate originalNBDate amountPaidOnBuildingClaim
amountPaidOnContentsClaim amountPaidOnIncreasedCostOfComplianceClaim
postFIRMConstructionIndicator rateMethod smallBusinessIndicatorBuilding
totalBuildingInsuranceCoverage totalContentsInsuranceCoverage yearOfLoss
primaryResidenceIndicator buildingDamageAmount buildingDeductibleCode
netBuildingPaymentAmount buildingPropertyValue causeOfDamage
condominiumCoverageTypeCode contentsDamageAmount contentsDeductibleCode
netContentsPaymentAmount contentsPropertyValue disasterAssistanceCoverageRequired
eventDesignationNumber ficoNumber floodCharacteristicsIndicator floodWaterDuration
floodproofedIndicator floodEvent iccCoverage netIccPaymentAmount
nfipRatedCommunityNumber nfipCommunityNumberCurrent nfipCommunityName
nonPaymentReasonContents nonPaymentReasonBuilding numberOfUnits
buildingReplacementCost contentsReplacementCost replacementCostBasis
stateOwnedIndicator waterDepth floodZoneCurrent buildingDescriptionCode
rentalPropertyIndicator state reportedCity reportedZipCode countyCode censusTract
censusBlockGroupFips latitude longitude id
""".split()

CLAIMS = columns(CLAIMS_DDL)
CLAIM_DATES = ("originalConstructionDate", "originalNBDate", "dateOfLoss", "asOfDate")

CROSSWALK = columns(
    "zip_code string, po_name string, state string, zip_type string, zcta string, zip_join_type string"
)

# The index file holds the first two columns; a dumped table holds all three.
PRICE_INDEX_FILE = columns("observation_date date, cpi_value decimal(10,3)")
PRICE_INDEX = columns("observation_date date, cpi_value decimal(10,3), cpi_year int")

LAND_COVER = T.StructType(
    [T.StructField("ZCTA20", T.StringType()), T.StructField("YEAR", T.IntegerType())]
    + [
        field
        for name in LAND_CLASSES
        for field in (
            T.StructField(name, T.LongType()),
            T.StructField(f"PROP_{name}", T.DecimalType(15, 13)),
        )
    ]
)

# --- fixed values: place-code reference columns, in file order ----------------
PLACE_CODES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "State Name",
            "County Name",
            "City Name",
            "State Code",
            "State FIPS Code",
            "County Code",
            "StCnty FIPS Code",
            "City Code",
            "StCntyCity FIPS Code",
        )
    ]
)

