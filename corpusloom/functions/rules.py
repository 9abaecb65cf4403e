"""Word lists, patterns and limits of the rules."""

# Word lists, patterns and limits that results depend on.
CPP_MARKERS = ("#include", "std::", "cout", "cin", "int main", "nullptr", "template<", "class ", "namespace", "vector<")
JAVA_MARKERS = ("public static void", "System.out", "import java", "public class ", "String[]")
PYTHON_MARKERS = ("def ", "import ", "print(")
CSHARP_MARKERS = ("using System", "using Windows", "public sealed", "IActionResult", "Console.WriteLine", "namespace ")
LANGUAGE_WORDS = {
    "fr": ("le ", "la ", "les ", "des ", "est ", "une "),
    "en": ("the ", "is ", "are ", "for ", "and ", "this "),
    "de": ("der ", "die ", "das ", "und ", "ist ", "ein "),
}
CORRUPT_MARKERS = ("Ġ", "Ċ", "Ã©", "Ã¨", "Ã ", "Ã§", "Ãª", "Ã®", "Ã´", "Ã»", "Ã¹", "Â°", "â\x82¬")
REASONING_PATTERN = r"(?i)(^|[^\p{L}\p{N}_])(why|step by step|explain|prove|reason|analyze|compare|derive|pourquoi|raison|[éÉ]tape|expliquer|d[éÉ]montrer|analyser|comparer)([^\p{L}\p{N}_]|$)"
CODE_PATTERN = r"```|def\s+\w|class\s+\w|function\s+\w|import\s+\w"
THINK_BLOCK = r"(?is)\[THINK\].*?\[/THINK\]|<think>.*?</think>|<reasoning>.*?</reasoning>"
THINK_MARK = r"(?i)\[/?THINK\]|</?think>|</?reasoning>"
PAGE_LINE = r"(?im)^(?:(?:Page\s+)?\d+(?:\s+of\s+\d+)?|AN\d+|Rev\.?\s*\d+|Doc\s*ID\s*\d+|www\.\S+)\s*$"
LEAK_PATTERN = r"(?i)\b(JSONL|JSON Lines|\"label\"|generate.{0,20}prompts)\b"
PII_PATTERNS = (
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b(?:\+\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
    ("ip_address", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)
TECHNICAL_IPS = ("0.", "1.", "255.", "127.", "192.168.")
PERIPHERALS = (
    ("bluetooth", "bluetooth"), ("ble", "bluetooth"), ("wifi", "wifi"), ("i2c", "I2C"), ("spi", "SPI"), ("uart", "UART"), ("usart", "UART"),
    ("adc", "ADC"), ("dac", "DAC"), ("pwm", "PWM"), ("timer", "timer"), ("gpio", "GPIO"), ("dma", "DMA"), ("flash", "FLASH"), ("rtc", "RTC"),
    ("watchdog", "watchdog"), ("wdt", "watchdog"), ("can", "CAN"), ("ethernet", "ethernet"), ("usb", "USB"), ("i2s", "I2S"),
    ("led", "LED/GPIO"), ("interrupt", "interrupt"), ("exti", "interrupt"), ("rtos", "RTOS"), ("freertos", "RTOS"), ("sleep", "power-mgmt"),
    ("deep_sleep", "power-mgmt"), ("low_power", "power-mgmt"),
)
TITLE_RULES = (
    (("configuration", "setup", "getting started"), "configure"),
    (("overview", "introduction", "description"), "overview"),
    (("schematic", "circuit", "layout", "design"), "design"),
    (("example", "application", "use case"), "example"),
    (("troubleshoot", "debug", "error", "issue"), "troubleshoot"),
)
SPDX_ALLOWED = {"D1": ("MIT", "Apache-2.0", "CC0-1.0", "GPL-3.0"), "D2": ("CC0-1.0",), "D3": ("MIT", "Apache-2.0", "CC0-1.0", "GPL-3.0")}
SOURCE_TYPE_ALLOWED = {"D1": ("github_scrape",), "D2": ("synth",), "D3": ("mix",)}
VALIDATION_LOSS = (0.05, 1.5)
TOKEN_LIMITS = (256, 512, 1024, 2048, 4096, 8192, 16384)
HIGH_SIGNAL_KINDS = ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "IBAN_CODE", "US_SSN", "US_PASSPORT", "UK_NHS", "CRYPTO", "MEDICAL_LICENSE")
SPDX_SPELLINGS = (
    "MIT", "Apache-2.0", "CC0-1.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "MPL-2.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CERN-OHL-S-2.0", "CERN-OHL-P-2.0", "CERN-OHL-W-2.0",
)
EMBEDDED_WORDS = (
    r"(?i)\b(no_std|cortex|embassy|hal|gpio|interrupt|peripheral|register|volatile|unsafe|pac::|dp::|embedded|firmware|microcontroller|"
    r"rtic|defmt|probe|flash|uart|spi|i2c|pwm|adc|dma|timer|bare.?metal|#\[entry\]|#\[interrupt\]|embedded.hal|"
    r"stm32|nrf|esp32|esp.hal|cortex.m|svd2rust|probe.rs)\b"
)
RUST_PLATFORMS = (("nrf", "nrf"), ("stm32", "stm32"), ("esp", "esp32"), ("rp2040", "rp2040"), ("rp23", "rp2350"), ("microbit", "nrf-microbit"), ("f3discovery", "stm32-f3discovery"))
DESIGNATORS = (
    ("R", "resistor"), ("C", "capacitor"), ("U", "IC"), ("Q", "transistor"), ("D", "diode"), ("L", "inductor"), ("J", "connector"), ("SW", "switch"),
    ("F", "fuse"), ("Y", "crystal"), ("T", "transformer"), ("K", "relay"), ("LED", "LED"), ("FB", "ferrite bead"),
)
EXAMPLE_CATEGORIES = (
    ("json-parsing", ("json", "deserialize", "serialize", "arduinojson")),
    ("communication-mqtt", ("mqtt", "pubsub")),
    ("sensors", ("adafruit_sensor", "dht", "temperature", "humidity", "pressure", "accel", "gyro", "bme", "bmp")),
    ("communication-spi", ("spi.begin", "spi.transfer", "spi.h")),
    ("communication-i2c", ("wire.begin", "wire.request", "i2c", "twi")),
    ("communication-wifi", ("wifi", "ethernet", "wificlient", "ethclient")),
    ("servo-motor", ("servo", "motor", "stepper")),
    ("display", ("lcd", "display", "oled", "tft", "screen")),
    ("data-storage", ("eeprom", "sd.begin", "flash", "storage")),
    ("analog-io", ("analogread", "analogwrite", "pwm", "fade")),
    ("digital-io", ("digitalread", "digitalwrite", "button", "pinmode")),
    ("timing", ("millis()", "micros()", "interrupt", "attachinterrupt")),
    ("strings", ("string ", "indexof", "substring", "startswith", "charat")),
    ("control-structures", ("arrays", "forloop", "whileloop", "switchcase")),
    ("communication-serial", ("serial.begin", "uart", "usart")),
)
BOILERPLATE_FILES = (
    "system_stm32f4xx.c",
    "system_stm32h7xx.c",
    "system_stm32l4xx.c",
    "stm32f4xx_it.c",
    "stm32h7xx_it.c",
    "stm32l4xx_it.c",
    "stm32f4xx_hal_msp.c",
    "stm32h7xx_hal_msp.c",
    "stm32l4xx_hal_msp.c",
)
EXAMPLE_FOLDERS = ("Examples", "Examples_LL", "Examples_MIX")
CIRCUIT_TYPES = {
    "power": r"(?i)(LDO|regulator|buck|boost|SMPS|TPS\d|LM78\d|AMS1117|MCP170\d|AP2112|RT9080|XC6206|HT7333|charge[_ ]?pump|DCDC|DC.DC|voltage.?reg|power.?supply|NCP1117|ADP\d|TLV\d|MP\d{4})",
    "mcu": r"(?i)(STM32|ESP32|ATmega|ATSAMD|nRF52|RP2040|PIC\d|MSP430|XTAL|crystal|HSE|LSE|decoupling|boot0|NRST|SWD|JTAG|microcontroller|MCU|ARM|Cortex)",
    "interface": r"(?i)(UART|USART|RS232|RS485|I2C|SPI|USB[- ]?C|USB.?Type|CAN.?bus|level.?shift|pull.?up|EIA|MAX3232|CH340|CP2102|FT232|FTDI|MCP2551|SN65HVD|ISO7721)",
    "sensor": r"(?i)(ADC|analog.?front|Wheatstone|thermocouple|RTD|PT100|BME\d|BMP\d|SHT\d|MPU\d|ICM\d|LIS\d|ADXL|INA\d|current.?sense|voltage.?divider|opamp|op.?amp|instrumentation)",
    "motor": r"(?i)(H.?bridge|BLDC|stepper|DRV\d|L298|TB67|A4988|TMC\d|motor.?driver|PWM|gate.?driver|half.?bridge|full.?bridge)",
    "audio": r"(?i)(amplifier|DAC|ADC|codec|I2S|TLV320|WM\d|MAX98|TPA\d|LM386|PAM\d|microphone|speaker|headphone|audio)",
    "rf": r"(?i)(antenna|SMA|RF|matching|balun|filter|SAW|PA.?module|LNA|mixer|VCO|PLL|LoRa|SX127|CC1101|nRF24|BLE|WiFi|impedance.?match|50.?ohm)",
    "protection": r"(?i)(TVS|ESD|fuse|polyfuse|PPTC|reverse.?polarity|overvoltage|crowbar|clamp|suppressor|protection|SMBJ|SMAJ|PESD|USBLC|spark.?gap|inrush|NTC|thermistor.?protect)",
    "connector": r"(?i)(header|JST|Molex|barrel.?jack|screw.?terminal|D-Sub|RJ45|ethernet|USB.?connector|SD.?card|micro.?SD|SIM|pin.?header|IDC|FPC|ZIF|edge.?connector)",
    "display": r"(?i)(OLED|LCD|TFT|LED.?driver|backlight|SSD1306|ST7735|ILI\d|WS2812|NeoPixel|Charlieplex|MAX7219|HT16K33|segment.?display|dot.?matrix)",
    "memory": r"(?i)(EEPROM|Flash|SRAM|SDRAM|FRAM|AT24|W25Q|IS25|SST\d|MX25|S25FL|NOR.?flash|NAND|PSRAM)",
}
